"""Part of the sparkloom engine."""
