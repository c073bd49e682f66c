"""wakeline: maritime-trace analytics as Spark DataFrame plans."""
