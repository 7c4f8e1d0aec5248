"""lodestone: labelled-text and embedding analytics as Spark DataFrame programs."""
