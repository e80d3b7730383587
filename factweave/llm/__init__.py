"""Operators a training-data pipeline needs beside the claim-verification engine.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is there.
"""
