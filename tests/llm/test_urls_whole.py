"""The URL models against counts of all runs in memory."""

from __future__ import annotations

import random
from collections import Counter

from strikeloom.llm import urls
from strikeloom.llm.queries import URL_RULES


def test_margins_are_those_of_all_runs(spark):
    draw = random.Random(7)
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789-é", k=draw.randint(3, 12)))
    hosts = ["www.example.com/en/7", "www.example.com/en/3", "a.net/de/", "b.example.net/de/8", "c.org/es/", "d.org/fr/", "e.info/"]
    texts = [f"http://{hosts[i % 7]}{word()}/{word()}" for i in range(3000)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None), (-2, texts[6])], "page_id long, url string").repartition(3)
    chosen = urls.Rules(URL_RULES)
    counts = {urls.ALLOW: Counter(), urls.BLOCK: Counter()}
    for url in [*texts, texts[6]]:
        verdict = chosen.find(*urls.host_path(url))[1]
        if verdict is not None and not urls.held_back(url):
            counts[verdict].update(urls.grams(url, 5))
    assert sum(n == 1 for c in counts.values() for n in c.values()) > 10_000
    a, b = (urls.Markov(dict(counts[v]), 5) for v in (urls.ALLOW, urls.BLOCK))
    model = urls.fit(df, URL_RULES)
    got = urls.judge(df, URL_RULES, model).collect()
    assert Counter(r.page_id for r in got) == Counter([*range(3000), -1, -2])
    for r in got:
        url = texts[6] if r.page_id == -2 else "" if r.page_id == -1 else texts[r.page_id]
        if r.rule is not None:
            assert r.margin is None
            continue
        want = (a.log_likelihood(url) - b.log_likelihood(url)) / (len(url) + 1)
        assert abs(r.margin - want) < 1e-6
        assert r.verdict == (urls.ALLOW if want >= model.threshold else urls.BLOCK)
    assert sum(r.rule is None for r in got) > 800
