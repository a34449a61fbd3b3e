"""Training-data operators. Nothing outside this subpackage imports it; the queries are in ``queries``."""
