"""PySpark-native engine for a catalog of geolocated facilities and the text corpora around it."""
