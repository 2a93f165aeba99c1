"""Spark-native maritime analytics: AIS reports to voyages, detections, incidents and vessel risk."""
