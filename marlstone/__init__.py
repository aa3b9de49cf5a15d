"""Marlstone: Spark-native market-monitoring analytics."""
