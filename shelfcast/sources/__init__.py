"""Raw scans, catalogue loads, published tables and the test-table adapters."""
