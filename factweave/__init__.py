"""Claim-verification data engine on PySpark."""
