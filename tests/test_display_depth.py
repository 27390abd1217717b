"""Display lines nested at any depth."""

import json

from quire.sources.pages import parse_display_lines


def test_text_is_found_at_every_depth(spark):
    def nested(n):
        inner = [{"text": f"at {n}", "x": n, "y": 0, "width": 9, "height": 9}, {"other": [1, None, "]}", {"Text": f"deep {n}"}]}]
        for _ in range(n):
            inner = [{"k": inner, "note": "\"[{\\"}]
        return json.dumps({"contents": inner})

    depths = [0, *range(3, 21), 150]
    pages = spark.createDataFrame([(n, 1, nested(n)) for n in depths] + [(999, 1, "[{"), (998, 1, None)], "doc_id long, page_no int, raw string")
    got = {(r.doc_id, r.text) for r in parse_display_lines(pages).collect()}
    assert got == {(n, f"{word} {n}") for n in depths for word in ("at", "deep")}
