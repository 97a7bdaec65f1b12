"""Training-data operators. Nothing outside this folder imports it; its queries are listed in ``queries``."""
