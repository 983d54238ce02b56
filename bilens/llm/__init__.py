"""Operators for preparing training corpora at cluster scale.

Nothing outside this folder imports it, apart from ``__spark_entry__``'s guarded
import.
"""
