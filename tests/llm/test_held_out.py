"""Trained operators on what they weren't fitted on: pages of other markup and wording, labels of the other half."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.llm import html_model, quality

WORDS = """the a river council said that new bridge would open after long delay because engineers found cracks in its northern
tower and residents who had waited for years were told to wait again while budget committee met on monday evening""".split()


def other_page(rng, style):
    """Sections by semantic elements, boxes with names that no list knows, nameless boxes, or cells of a layout table."""
    def sentence(low=6, high=24):
        return " ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))).capitalize() + rng.choice("...?!")

    def short():
        return " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))).title()

    def links(low, high):
        return "<ul>" + "".join(f'<li><a href="/{k}">{short()}</a></li>' for k in range(rng.randint(low, high))) + "</ul>"

    def box(inner, *names):
        return f"<div{f' class={rng.choice(names)}' if style == 'named' else ''}>{inner}</div>"

    def part():
        kind, yes = rng.random(), ' data-y="1"'
        if kind < 0.7:
            return f"<p{yes}>{' '.join(sentence() for _ in range(rng.randint(1, 6)))}</p>"
        if kind < 0.8:
            return f"<h2{yes}>{short()}</h2>"
        return f"<ul><li{yes}>{sentence()}</li><li{yes}>{sentence()}</li></ul>" if kind < 0.9 else f"<blockquote><p{yes}>{sentence()}</p></blockquote>"

    article = f'<h1 data-y="1">{short()} {short()}</h1>' + "".join(part() for _ in range(rng.randint(3, 12)))
    menu, side, foot = links(4, 9), f"<h3>{short()}</h3>{links(3, 7)}", f"<p>{short()} 2021 {short()}. All rights kept.</p>{links(3, 3)}"
    if style == "semantic":
        return f"<body><header><nav>{menu}</nav></header><main><article>{article}</article></main><aside>{side}</aside><footer>{foot}</footer></body>"
    if style == "table":
        return f"<body><table><tr><td>{menu}</td></tr><tr><td>{article}</td><td>{side}</td></tr><tr><td>{foot}</td></tr></table></body>"
    said = "".join(box(f"<b>{short()}</b><p>{sentence(3, 12)}</p>", "u7", "voice") for _ in range(rng.randint(1, 4))) if rng.random() < 0.5 else ""
    return "<body>" + box(menu, "strip", "hd1") + box(article, "pane", "lead-col") + box(side, "rail", "s2") + box(said, "voices", "readers") + box(foot, "end", "btm") + "</body>"


@pytest.mark.parametrize(("style", "precision", "recall"), [("semantic", 0.99, 0.99), ("named", 0.95, 0.98), ("bare", 0.95, 0.98), ("table", 0.99, 0.6)])
def test_pages_of_other_markup(style, precision, recall):
    """Precision and recall of characters."""
    model, rng, right, kept, wanted = html_model.trained_model(), random.Random(3), 0, 0, 0
    for _ in range(100):
        page = html_model.Page(other_page(rng, style))
        for label, m, n in zip(page.label, model.marginals(page), page.chars, strict=True):
            right += n * (label == "1" and m >= 0.5)
            kept += n * (m >= 0.5)
            wanted += n * (label == "1")
    print(style, right / kept, right / wanted)
    assert right / kept >= precision
    assert right / wanted >= recall


@pytest.mark.parametrize("fold", [0, 1])
def test_quality_of_the_other_half(spark, fold):
    """Fitted on half of the labels; of the other half, documents that pass the base rules are judged by the ratio alone."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    half = F.pmod(F.xxhash64(F.lit(99), "doc_id"), F.lit(2)) == fold
    judged = quality.judge_quality(docs, labels.filter(half)).filter("not base_failed")
    rows = judged.join(labels.filter(~half).select("doc_id", "quality").distinct(), "doc_id").select("quality", "kept").collect()
    good, junk = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.85 * len(good) and len(good) > 100
    assert sum(junk) <= 0.1 * len(junk) and len(junk) >= 10
