"""Study analytics on PySpark: metrics, content operators and live feeds as DataFrame functions."""
