"""isogon: geomagnetic survey analytics expressed as Spark DataFrame plans."""
