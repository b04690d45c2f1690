"""Short articles of trusted blocks: what is taken, what is refused, what counts."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq

from tidewire.plans import QUERIES

NEWS = "A short piece of news with a single fact in it, and no more than that."
LONG = NEWS * 3


def test_short_articles(spark, tmp_path):
    pages = {
        1: (f"<nav>{LONG}</nav><article><h1>Head</h1><p>{NEWS}</p></article><p>{LONG}</p>", NEWS, "partial"),
        2: (f"<article><p>{LONG}</p></article>", LONG, "ok"),
        3: ("<article><p>" + "x" * 39 + "</p></article>", None, "extraction_failed"),
        4: ("<article><p>" + "x" * 40 + "</p></article>", "x" * 40, "partial"),
        5: (f"<article><p>{NEWS}</p><p>Войдите, чтобы ОСТАВИТЬ комментарий к этой статье</p></article>", NEWS, "partial"),
        6: ("<article><p>Доступ к чату заблокирован за нарушение правил, обратитесь в поддержку</p></article>", None, "extraction_failed"),
        7: (f"<article><h1>{LONG}</h1></article>", None, "extraction_failed"),
        8: (f"<article><p>{NEWS}</p><blockquote><p>Said one.</p> Who?</blockquote><p>Then.</p></article>", f"{NEWS}\n\nSaid one.\n\nWho?\n\nThen.", "partial"),
        9: ("<article><p><b>One letter once:<br><p>" + "y" * 60 + "<p>" + "z" * 60 + "</article>", f"One letter once:\n\n{'y' * 60}\n\n{'z' * 60}", "partial"),
        10: (f"<article><aside><p>{NEWS}</p></aside><figure><p>{NEWS}</p></figure><div class=ad><p>{NEWS}</p></div></article>", None, "extraction_failed"),
        11: (f"<p>{LONG}</p>", None, "extraction_failed"),
        12: (None, None, "extraction_failed"),
        13: ("<article><p>" + "x" * 199 + "</p></article>", "x" * 199, "partial"),
        14: ("<article><p>" + "x" * 200 + "</p></article>", "x" * 200, "ok"),
    }
    pq.write_table(pa.table({"page_id": pa.array(list(pages), pa.int64()), "html": [h for h, _, _ in pages.values()]}), tmp_path / "pages.parquet")
    got = QUERIES["short_safe_articles"](spark, str(tmp_path)).collect()
    assert {r["page_id"]: (r["text"], r["status"]) for r in got} == {k: (t, s) for k, (_, t, s) in pages.items()}
