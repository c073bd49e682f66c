"""Operations of a large-scale training-data pipeline, as Spark jobs.

Every operator takes and returns DataFrames.  Shared conventions, stated once:

* Only the columns an operator names are read; extra columns, whatever their
  names, never clash because inputs are projected to private names first.
* A null text is an empty text.  A null or repeated row id never merges rows:
  such inputs are given a private row key ordered by (id, text), nulls last.
* Empty inputs give empty outputs of the documented schema.
"""
