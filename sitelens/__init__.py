"""sitelens: Spark-native habitat and isotope analytics."""
