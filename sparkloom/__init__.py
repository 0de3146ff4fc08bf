"""sparkloom: corpus preparation and evaluation analytics expressed in PySpark."""
