"""A Spark-native engine for collections of policy documents."""
