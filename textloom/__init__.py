"""textloom: analytics over text corpora as plain Spark jobs.

Every public function takes DataFrames (or Columns) and returns DataFrames (or Columns);
nothing here keeps a global session.
"""
