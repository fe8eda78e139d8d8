"""Conversation repair, main texts and centroid clustering against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest

from terrado.llm import clustering, conversations, pages

# 11: conversation repair -----------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    """Rows of one conversation, in order, with their faults."""
    seen, out = set(), []
    for _, _, role, text in rows:
        cut = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not cut else "duplicate" if (role, text) in seen else "truncated" if cut[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def all_scripts(rows, marks):
    """Every way to edit with at most one turn put in at a place: (cost, audit, repaired)."""
    choices = []
    for (_, _, role, text), mark in zip(rows, marks, strict=True):
        more, ways = 3 if mark == "truncated" else 0, [(4, "D", None)]
        if mark not in ("blank", "duplicate"):
            ways += [(more, "K", (role, text)), (3 + more, "R", ("user", text)), (3 + more, "R", ("assistant", text))]
        choices.append(ways)
    gaps = [[(0, "", None), (3, "I", ("user", "")), (3, "I", ("assistant", ""))]] * (len(rows) + 1)
    for put, ways in itertools.product(itertools.product(*gaps), itertools.product(*choices)):
        steps = [put[0], *(x for pair in zip(ways, put[1:], strict=True) for x in pair)]
        made = [s[2] for s in steps if s[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(role[:1] or "-" for role, _ in made)):
            yield sum(s[0] for s in steps), "".join(s[1] for s in steps), "\n".join(f"{r}:{t}" for r, t in made)


def forward(rows, marks):
    """The same for long conversations: the best (cost, audit, roles made) for each state, row by row."""
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def put_in(best):
        for _ in range(3):
            for (state, role), to in moves.items():
                if role != "s" and state in best:
                    c, a, m = best[state]
                    new = (c + 3, a + "I", m + [({"u": "user", "a": "assistant"}[role], "")])
                    if to not in best or new[:2] < best[to][:2]:
                        best[to] = new
        return best

    best = put_in({"": (0, "", [])})
    for (_, _, role, text), mark in zip(rows, marks, strict=True):
        after = {state: (c + 4, a + "D", m) for state, (c, a, m) in best.items()}
        if mark not in ("blank", "duplicate"):
            for (state, to_role), to in moves.items():
                if state not in best:
                    continue
                c, a, m = best[state]
                more = 3 if mark == "truncated" else 0
                if role[:1] == to_role:
                    new = (c + more, a + "K", m + [(role, text)])
                elif to_role != "s":
                    new = (c + 3 + more, a + "R", m + [({"u": "user", "a": "assistant"}[to_role], text)])
                else:
                    continue
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        best = put_in(after)
    cost, audit, made = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in made)


def expected_report(rows, script=forward):
    kept = damaged(rows)
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        mine = [r for r in kept if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).digest()))
        marks, turns = faults(mine), [r[1] for r in mine if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, whole = min(script(mine, marks)) if script is all_scripts else script(mine, marks)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_repair_against_every_script(spark):
    rng = random.Random(5)
    rows = [
        (conv, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(["Yes.", "no", " ", None, "A b?\n", "Yes."]))
        for conv in [*range(60), None]
        for _ in range(rng.randint(1, 3))
    ]
    made = [tuple(r) for r in conversations.repair_report(spark.createDataFrame(rows, TURNS)).collect()]
    small = [r for r in rows if len(damaged([x for x in rows if x[0] == r[0]])) <= 4]
    want = expected_report(small, all_scripts)
    assert len(want) > 50
    assert order(r for r in made if r[0] in {w[0] for w in want}) == order(want)
    assert order(made) == order(expected_report(rows))


def test_repair_of_long_conversations(spark):
    rng = random.Random(6)
    texts = [f"t{i}." for i in range(400)] + ["cut", "", " \t"]
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(texts)) for t in range(1500)]
    rows += [(2, None, "user", "Same.")] * 700 + [(3, 7, "assistant", "Hm.")] + [(4, t, "ua"[t % 2] + "x", f"{t}!") for t in range(300)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, 2, b"x", True, "k") for r in rows], TURNS + ", n long, part long, digest binary, edge boolean, kind string")
    made = [tuple(r) for r in conversations.repair_report(frame.repartition(5)).collect()]
    assert order(made) == order(expected_report(rows))
    turns = conversations.repair_conversations(frame).collect()
    for conv, audit, digest in ((r[0], r[7], r[8]) for r in made):
        mine = sorted((r for r in turns if r.conv_id == conv), key=lambda r: r.position)
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == digest
        assert "".join(r.edit for r in mine) == audit.replace("D", "")


def test_repair_by_runs_over_many_partitions(spark):
    """More partitions than runs in a group, so that several rounds multiply the runs."""
    rows = [(9, t, "user" if t % 3 else "assistant", f"{t}.") for t in range(600)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        made = [tuple(r) for r in conversations.repair_report(spark.createDataFrame(rows, TURNS)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made == expected_report(rows)


def test_repair_of_nothing_and_of_rows_that_all_go(spark):
    assert conversations.repair_report(spark.createDataFrame([], TURNS)).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    made = conversations.repair_report(spark.createDataFrame([(5, gone, "user", "x.")], TURNS)).collect()
    assert [tuple(r) for r in made] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_matrices_are_associative():
    rng = random.Random(1)
    for _ in range(200):
        a, b, c = (conversations.block_matrix("".join(rng.choice("suaoxSUAO") for _ in range(rng.randint(1, 4)))) for _ in range(3))
        assert conversations.product(conversations.product(a, b), c) == conversations.product(a, conversations.product(b, c))
    assert conversations.power(conversations.turn_matrix("x"), 5) == conversations.block_matrix("xxxxx")


# 12: main texts --------------------------------------------------------------------------------

WORDS = "The house by the river, old and quiet, has three rooms, a garden and a view. "


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p> \n </p>", ""),
        ("plain &amp; simple\n text", "plain & simple text"),
        ("<p>One<br>two<p>three <b>fo</b>ur", "One two three four"),
        ("<nav><a href=x>Menu</a></nav><article><h1>T</h1><p>Short.</article><footer>End</footer>", "T Short."),
        ("<article><p>a<!-- no -->b<script>if (a<b) '</p>'</script>c</p><style>x</style></article>", "abc"),
        ("<article><p>1 &lt; 2 &copy; &#233;&#x41;&nbsp;z</p></article>", "1 < 2 © éA z"),
        (f"<div class='content'><p>{WORDS}</p><p>{WORDS}</p></div><div class='comments'><p>{WORDS * 9}</p></div>", f"{WORDS}{WORDS}".strip()),
        (f"<main><article><p>{WORDS}</p><aside>Side</aside><div class=ad-box>Buy</div><form><label>Mail</label></form><p>Last.</p></article></main>", f"{WORDS}Last."),
        (f"<article><header><h1>Title</h1><p>By me</p></header><p>{WORDS}</p><div id=respond>Reply</div></article>", f"Title {WORDS}".strip()),
        (f"<div><p>{WORDS}</p><table><tr><td>a<td>b</table><ul><li>one<li>two</ul></div><div><a href=x>Far, far, far</a> <a>away</a></div>", f"{WORDS}a b one two"),
        (f"<div id=cookie-notice>We use cookies, many, many.</div><div><div><p>{WORDS}</p></div><div><p>{WORDS}{WORDS}</p></div></div>", f"{WORDS}{WORDS}{WORDS}".strip()),
        (f"<form action=x><main><p>{WORDS}</p><input><button>Go</button></main></form>", WORDS.strip()),
        (f"<body class='has-sidebar'><p>{WORDS}</p><p hidden>no</p><p style='display: none'>no</p></body></html>", WORDS.strip()),
        (f"<ul><li><a href=a>Home</a></li></ul><p>{WORDS}</p><p>Then.</p>", f"{WORDS}Then."),
        ("<article><p>cut in a tag</p><a href='", "cut in a tag"),
        ("<article><p>cut in a comment <!-- x </p>", "cut in a comment"),
        ("<article><p>a < b, c<d</p></article>", "a < b, c"),
        ("<p>&#99999999999; &#00000000065; &amp &am</p>", "� A & &am"),
    ],
)
def test_main_text(source, text):
    assert pages.main_text(source) == text


@pytest.mark.parametrize("piece", ["<div>", "<p>", "<li><ul>", "</p>", "<a b='", "<!--", "<b ", "<span class=ad>", "<table><tr><td>", "&#9", "<", "='", "<a>x</a>"])
def test_broken_pages_in_linear_time(piece):
    began = time.time()
    pages.main_text(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 30


def plain_article(source):
    """For pages of the tables' form only: what stands in <article>, without markup."""
    import html

    inner = re.search(r"<article>(.*?)(</article>|$)", source, re.S)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner[1])).split()) if inner else ""


def test_main_texts_frame(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href='/x'>x</a></li></ul></nav><div class='ad'>Buy, now, all.</div><article><h1>{0}</h1><p><b>{0}<br><p>{1}</p></article><footer>&copy; f</footer>"
    rng = random.Random(2)
    rows = [(i, f"u{i}", page.format(f"Title {i}&amp;{i}", " ".join(rng.choice("a,bé.") * 3 for _ in range(rng.randint(1, 3000))))) for i in range(80)]
    rows += [(1, None, None), (1, "u", ""), (None, "u", "x"), rows[0], rows[0]]
    frame = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    made = pages.main_texts(frame).collect()
    want = [(i, u, plain_article(h) if h and "<" in h else h or "") for i, u, h in rows]
    assert order((r.page_id, r.url, r.text) for r in made) == order(want)
    assert all(r.n_chars == len(r.text) for r in made)
    assert pages.main_texts(frame.limit(0)).collect() == []


# 13: clusters ----------------------------------------------------------------------------------


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), np.array(v, "<i4").tobytes(), v) for i, v in kept)
    centroids = [v for _, _, v in first[:k]]

    def assign():
        out = []
        for i, v in kept:
            far = [(sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)]
            out.append((i, v, min(far)[1], min(far)[0]))
        return out

    for _ in range(rounds):
        placed = assign()
        for n in range(len(centroids)):
            if mine := [v for _, v, m, _ in placed if m == n]:
                centroids[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    placed = assign()
    total = sum(d for *_, d in placed)
    each = {n: sum(d for _, _, m, d in placed if m == n) for n in range(len(centroids))}
    return [(i, n, d, each[n], total, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, _, n, d in placed]


def test_clusters_against_plain_version(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 64)]) for i in range(150)]
    rows += [(i, rows[7][1]) for i in range(150, 260)]  # a third of all is one vector
    rows += [(1, rows[1][1]), (1, rows[1][1]), (None, [0.5] * 64), (300, None), (301, []), (302, [0.1] * 63), (303, [0.1] * 65)]
    rows += [(304, [float("nan")] + [0.0] * 63), (305, [None] + [0.0] * 63), (306, [float("inf")] * 64), (307, [-1.0 / 64] * 64), (308, [1e6] * 64)]
    frame = spark.createDataFrame([(i, v, 1, 2, 0) for i, v in rows], "vec_id long, embedding array<double>, label int, cluster int, square long")
    made = [tuple(r) for r in clustering.cluster_vectors(frame.repartition(7)).collect()]
    assert order(made) == order(plain_clusters(rows))


def test_clusters_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert clustering.cluster_vectors(spark.createDataFrame([], schema)).collect() == []
    rows = [(i, [float(i)] * 64) for i in range(5)]
    made = clustering.cluster_vectors(spark.createDataFrame(rows, schema)).collect()
    assert len({r.cluster for r in made}) == 5
    assert {(r.distance, r.inertia) for r in made} == {(0, 0)}
    too_far = [*rows, (9, [1e30] * 64)]  # takes no part: its distances have more than 64 bits
    assert len(clustering.cluster_vectors(spark.createDataFrame(too_far, schema)).collect()) == 5


def test_screening_leaves_out_most_centroids_and_never_the_nearest():
    rng = np.random.default_rng(4)
    centers = rng.integers(-400, 400, (16, 64)) * (rng.random((16, 64)) < 0.3)
    x = centers[rng.integers(0, 16, 4000)] + rng.integers(-9, 10, (4000, 64))
    screen = clustering.Screen(centers)
    cluster, far = screen.nearest(x, clustering.segment_norms(x, clustering.SEGMENT), (x * x).sum(axis=1))
    every = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all()
    assert (far == every.min(axis=1)).all()
    assert screen.exact < screen.all / 4
