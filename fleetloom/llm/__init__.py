"""Operators of a training-data pipeline: filters, language ID, de-duplication, decontamination, packing, scoring."""
