"""Analytics over replicated-log data, as DataFrame functions for PySpark."""
