"""screenlake: PySpark-native screening and statistics for conversational-AI traffic at table scale."""

__version__ = "0.1.0"
