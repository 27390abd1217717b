"""quire: page-layout and page-text analytics as Spark jobs.

Tables are keyed by ``(doc_id, page_no)``; every operator takes DataFrames and
returns DataFrames.  ``PAGE`` is that key.
"""

PAGE = ["doc_id", "page_no"]
