"""A PySpark-native analytics engine for entities seen through two noisy views."""
