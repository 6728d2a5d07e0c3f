"""A PySpark-native engine for sports-tracking data: detections in, tracks, teams and pitch positions out."""
