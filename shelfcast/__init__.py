"""shelfcast: retail demand, inventory and what-if analytics as Spark DataFrame operators.

Every operator is a function from DataFrames to a DataFrame.  Nothing here holds
hidden state, and no operator pulls rows to the driver; the few places that run a
job while building a plan (loud key checks, range cuts) say so.
"""

__version__ = "0.1.0"
