"""Upsert by unit over a stream of changed units: a file stream feeds `foreachBatch`."""
