"""loomwork: corpus preparation and evaluation as composable PySpark plans."""
