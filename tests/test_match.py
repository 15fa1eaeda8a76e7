"""The matcher's ways against plain loops over words and lines."""

from __future__ import annotations

import pytest

from veilspark.operators import match
from veilspark.plans.cases import MATCH_DOCS, TABLES
from veilspark.plans.queries import QUERIES

STRIP = ".,;:!?()[]\"'"


def page(text):
    """Lines as (content, words) with words as (text, left)."""
    out = []
    for content in text.split("\n"):
        words, at = [], 0
        for w in content.split():
            at = content.index(w, at)
            words.append((w, 50 + 6 * at))
            at += len(w)
        out.append((content, words))
    return out


def plain_occurrences(entity, text):
    lines = page(text)
    targets = [w for w in (x.strip(STRIP).lower() for x in entity.split()) if w]
    joined, needle, n = "".join(targets), entity.lower(), len(targets)
    flat = [(i, k, w, left) for i, (_, words) in enumerate(lines) for k, (w, left) in enumerate(words)]
    norm = [f[2].strip(STRIP).lower() for f in flat]
    found = []

    def line_box(i):
        return 50, 50 + 6 * len(lines[i][0])

    def add_words(places):
        for i in sorted({flat[p][0] for p in places}):
            mine = [flat[p] for p in places if flat[p][0] == i]
            box = line_box(i) if len(mine) == len(lines[i][1]) else (min(f[3] for f in mine), max(f[3] + 6 * len(f[2]) for f in mine))
            found.append((i, *box, False))

    p = 0
    while targets and p <= len(norm) - n:
        if norm[p : p + n] == targets:
            add_words(range(p, p + n))
            p += n
        else:
            p += 1
    if n >= 2 and not found:
        start = 0
        while True:
            places, q = [], start
            for t in targets:
                while q < len(norm) and norm[q] != t:
                    q += 1
                if q == len(norm):
                    places = None
                    break
                places.append(q)
                q += 1
            if not places:
                break
            if 12 * (max(flat[p][0] for p in places) - min(flat[p][0] for p in places)) <= 100:
                add_words(places)
            start = places[-1] + 1
    hit = {f[0] for f in found}
    for i, (_, words) in enumerate(lines):
        if i in hit or len(joined) < 4:
            continue
        mine = [(p, norm[p]) for p, f in enumerate(flat) if f[0] == i and norm[p]]
        for s in range(len(mine)):
            text_so_far = ""
            for e in range(s, len(mine)):
                text_so_far += mine[e][1]
                if text_so_far == joined:
                    if not (e == s and n == 1):
                        add_words([p for p, _ in mine[s : e + 1]])
                    break
                if len(text_so_far) > len(joined):
                    if e == s and text_so_far.startswith(joined):
                        left = flat[mine[s][0]][3]
                        found.append((i, left, left + 6 * len(joined), True))
                    break
    for i, _, w, left in flat:
        at = w.lower().find(needle)
        if at >= 0 and w.lower() != needle and (at == 0 or not w[at - 1].isalnum()) and not w[at + len(needle) : at + len(needle) + 1].isalnum():
            found.append((i, left + 6 * at, left + 6 * (at + len(needle)), True))
    hit = {f[0] for f in found}
    for i, (content, _) in enumerate(lines):
        if i not in hit and needle in content.lower():
            found.append((i, *line_box(i), True))
    if not found:
        spans, at, joined_text = [], 0, ""
        for i, (content, _) in enumerate(lines):
            if content.strip():
                at += bool(joined_text)
                joined_text += " " * bool(joined_text) + content.strip()
                spans.append((at, at + len(content.strip()), i))
                at += len(content.strip())
        q = joined_text.lower().find(needle)
        while q >= 0:
            found += [(i, *line_box(i), True) for s, e, i in spans if e > q and s < q + len(needle)]
            q = joined_text.lower().find(needle, q + len(needle))
    return {f[:3] for f in found}


@pytest.mark.parametrize("listed", [500, 3])
def test_all_ways(spark, monkeypatch, listed):
    monkeypatch.setattr(match, "MOST_LISTED", listed)
    found = {}
    for r in QUERIES["match_cases"](spark, "").collect():
        found.setdefault((r.entity, r.doc_id), set()).add((r.line_id, r.left, r.right))
    literals = [r[2] for r in eval(f"[{TABLES['literals'][1]}]")]
    wanted = {(entity, i): x for entity in literals for i, text in MATCH_DOCS if (x := plain_occurrences(entity, text))}
    assert found == wanted


def test_literals_without_hits_stay(spark):
    rows = QUERIES["crm_populate"](spark, "").collect()
    assert len(rows) == 11 * len(MATCH_DOCS) and any(r.hit for r in rows) and any(not r.hit for r in rows)
    assert match.MOST_SPAN == 100
