"""Operations of a training-data pipeline: deduplication, decontamination, filters, packing, scoring and scans.

Nothing outside this subpackage imports it.
"""
