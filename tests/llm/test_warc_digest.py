"""Payloads are grouped by a digest hashed once."""

from __future__ import annotations

import hashlib

from strata.llm import warc


def test_payloads_are_grouped_by_a_digest_hashed_once(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "é"]
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in warc.with_roles(pages).collect()}
    assert [rows[i]["digest"] for i in range(4)] == [hashlib.sha1((h or "").encode()).hexdigest() for h in html]
    assert [(rows[i]["record_type"], rows[i]["refers_to"]) for i in range(4)] == [
        ("revisit", 1), ("response", None), ("response", None), ("response", None)]
