"""paraspark: parallel-text preparation and translation scoring on Spark DataFrames.

Every operator is a plain function ``DataFrame -> DataFrame`` or ``Column -> Column``
so it composes with ``df.transform(...)`` and stays inside Catalyst's plan.

Layout
------
functions/  Column expressions (text normalisation, chat rendering, hashing, token labels)
operators/  DataFrame operators (row identity, validation, sampling, metrics, reports, joins)
sources/    readers and writers (CSV, JSONL, text, JSON reports, Parquet test tables)
plans/      end-to-end flows (prepare, re-weight, calibrate, evaluate) and fixture views
streaming/  the stateless prepare stage applied to a file stream
"""

from paraspark.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
