"""A Spark-native engine for cataloguing, reconciling and analysing large collections and their work queues."""
