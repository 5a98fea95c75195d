"""Nodes of documents in bounded batches."""

from __future__ import annotations

import pandas as pd

from grovewise.sources import documents


def test_nodes_of_a_batch_of_pages_come_in_parts():
    pages = pd.DataFrame({"doc": [str(i) for i in range(1000)], "text": ["<p>x</p>" * 9] * 1000})
    sizes = [len(out) for out in documents.shredded_batches(iter([pages]), documents.shred_html, False)]
    assert sum(sizes) == 9000 and max(sizes) < documents.SHREDDED + 9
