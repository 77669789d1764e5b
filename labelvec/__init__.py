"""Labelled-vector datasets on Spark: ingest, convert, pair, batch, train, score."""
