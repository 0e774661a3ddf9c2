"""Operators for preparing training data: filtering, de-duplication, packing, sharding, formats."""
