"""Operators 11 to 13: conversations, web pages and the audit of filters."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cases import awkward, nothing
from loadcast.llm import conversations, filter_audit, html_text, term_matrix
from loadcast.llm.queries import QUERIES, damage

LEGAL = re.compile(r"(s?(ua)+)?")
CONV = "conv_id long, turn long, role string, text string"


# --- conversations --------------------------------------------------------------------------

def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def judged(rows):
    """Faults of one conversation's rows in order."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, out = set(), []
    for _, turn, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def initials(roles):
    return "".join((r or "?")[0] for r in roles)


def replay(rows, audit):
    """(cost, repaired rows) of an audit string, or None where it does not fit."""
    rows, out, cost = list(rows), [], 0
    for edit in audit:
        follows = {"": "user", "s": "user", "a": "user", "u": "assistant"}[initials([out[-1][0]]) if out else ""]
        if edit == "I":
            out.append((follows, ""))
            cost += 3
            continue
        if not rows:
            return None
        _, role, text, fault = rows.pop(0)
        if edit == "D":
            cost += 4
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += (3 if edit == "R" else 0) + (3 if fault == "truncated" else 0)
        out.append((role if edit == "K" else follows, text))
        if not re.fullmatch(r"s?(ua)*u?", initials(r for r, _ in out)):
            return None
    return None if rows or not LEGAL.fullmatch(initials(r for r, _ in out)) else (cost, out)


def cheapest(rows):
    """All edit strings of up to two inserts in a place, the cheapest and least of them."""
    best = None
    places = [["".join(p) for n in range(3) for p in itertools.product("I", repeat=n)]] * (len(rows) + 1)
    for inserts in itertools.product(*places):
        for edits in itertools.product("DKR", repeat=len(rows)):
            audit = "".join(i + e for i, e in itertools.zip_longest(inserts, edits, fillvalue=""))
            done = replay(rows, audit)
            if done and (best is None or (done[0], audit) < best[:2]):
                best = (done[0], audit, done[1])
    return best


def summary(rows):
    turns = {t for t, *_ in rows if t is not None}
    letters = [(r or "?")[0] for _, r, _, _ in rows]
    return dict(gaps=max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                blank=sum(f == "blank" for *_, f in rows), duplicate=sum(f == "duplicate" for *_, f in rows),
                truncated=sum(f == "truncated" for *_, f in rows),
                illegal=sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])))


def sha(rows):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


def test_edits_equal_an_exhaustive_search(spark):
    rnd = random.Random(5)
    rows = []
    for conv in range(60):
        for turn in range(rnd.randrange(1, 5)):
            role = rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "Sudo", "", None])
            text = rnd.choice(["Fine.", "Fine!  ", "no end", "", "\x0b \x1c", "\xa0", None, "Ça? \n", "."])
            rows.append((conv, rnd.choice([turn, turn, turn, 7, None]), role, text))
    frame = spark.createDataFrame(rows, CONV)
    got = {r.conv_id: r.asDict() for r in conversations.repair(frame).collect()}
    assert len(got) == 60
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    for conv, own in by.items():
        own = judged(own)
        cost, audit, kept = cheapest(own)
        want = dict(summary(own), conv_id=conv, cost=cost, audit=audit, repaired_sha256=sha(kept))
        assert got[conv] == want, own
    for conv, own in itertools.groupby(sorted(conversations.repaired_rows(frame).collect(), key=lambda r: (r.conv_id, r.place)), lambda r: r.conv_id):
        own = list(own)
        assert [r.place for r in own] == list(range(len(own)))
        assert sha([(r.role, r.text) for r in own]) == got[conv]["repaired_sha256"]
        assert all((r.edit == "insert") <= (r.turn is None) for r in own)


def test_damage_is_as_stated_and_every_conversation_has_a_row(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(c if c else None, t, rnd.choice(["system", "user", "assistant", None]), rnd.choice(["A. b", "c?", None, "d"]))
            for c in range(300) for t in range(rnd.randrange(1, 3))]
    rows += [(c, None, "user", "x.") for c in range(400, 460)]
    spark.createDataFrame(rows, CONV).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r.asDict() for r in QUERIES["op11_conversations"][0](spark, str(tmp_path)).collect()}
    by = {c: [] for c, *_ in rows}
    for r in damaged(rows):
        by[r[0]].append(r)
    assert set(got) == set(by) and any(not own for own in by.values())
    for conv, own in by.items():
        own = judged(own)
        cost, audit, kept = cheapest(own)
        assert got[conv] == dict(summary(own), conv_id=conv, cost=cost, audit=audit, repaired_sha256=sha(kept))


def test_a_giant_conversation_crosses_batches(spark):
    rnd = random.Random(7)
    rows = [(1, t, rnd.choice(["user", "assistant"]), rnd.choice(["", "So.", "cut", f"own {t}."])) for t in range(9000)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")]
    frame = spark.createDataFrame(rows, CONV).repartition(5)
    got = {r.conv_id: r for r in conversations.repair(frame).collect()}
    own = judged([r for r in rows if r[0] == 1])
    cost, kept = replay(own, got[1].audit)
    assert cost == got[1].cost and sha(kept) == got[1].repaired_sha256
    # The least cost, by a plain forward programme.
    after = {("", "u"): "u", ("", "s"): "s", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}

    def relaxed(best):
        for _ in range(3):
            for s in list(best):
                best[follows[s]] = min(best.get(follows[s], 9e9), best[s] + 3)
        return best

    best = {"": 0}
    for _, role, _, fault in own:
        new = {}
        for s, c in relaxed(best).items():
            late = 3 if fault == "truncated" else 0
            options = [(s, c + 4)]
            if fault not in ("blank", "duplicate"):
                options.append((follows[s], c + 3 + late))
                if (s, role[0]) in after:
                    options.append((after[s, role[0]], c + late))
            for t, k in options:
                new[t] = min(new.get(t, 9e9), k)
        best = new
    best = relaxed(best)
    assert cost == min(best.get("", 9e9), best.get("a", 9e9))
    assert got[2].audit == "KK" and got[2].cost == 0


def test_conversations_empty_table_and_other_columns(spark):
    frame = spark.createDataFrame([("x", 1, "user", "a.", "v", "w")], "conv_id string, turn int, role string, text string, edits string, `a.b` string")
    row = conversations.repair(frame).collect()[0]
    assert (row.conv_id, row.audit, row.cost) == ("x", "KI", 3)
    assert conversations.repair(frame.limit(0)).count() == conversations.repaired_rows(frame.limit(0)).count() == 0
    gone = conversations.repair(frame, present=F.lit(None).cast("boolean")).collect()[0]
    assert (gone.audit, gone.cost, gone.repaired_sha256) == ("", 0, sha([]))


def test_conversations_are_dealt_out_once(spark):
    rows = damage(spark.createDataFrame([(1, 0, "user", "a.")], CONV))
    plan = conversations.repair(rows, present=F.col("present"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("MapInArrow") == 2


# --- pages ----------------------------------------------------------------------------------

LONG = "The ship was at sea for the whole of the night and it was not until the dawn that the crew could see the land."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>One</p><p> two\n\t three </p>", "One\ntwo three"),
    (f"<nav><ul><li><a href='/'>Home</a></ul></nav><p>{LONG}</p><footer>&copy; me</footer>", LONG),
    (f"<div class='cookie-notice'>{LONG} Accept.</div><article><h1>T &amp; U</h1><p>{LONG}<br>x&nbsp;y</p><p>Short</p></article>",
     f"T & U\n{LONG} x y\nShort"),
    (f"<article><p>Short</p></article><div>{LONG}</div>", "Short"),
    (f"<main><p>{LONG}</p><aside>{LONG}</aside><form>{LONG}<input></form><div id=comments><p>{LONG}</p></div></main>", LONG),
    (f"<article><p>{LONG}</p></article><section><article class='comment'><p>{LONG}</p></article></section>", LONG),
    (f"<div class=ad>{LONG}<article><p>{LONG}</p></article>", LONG),
    (f"<article><p><b>{LONG}<p>b</article><div class='related'><p>{LONG}</p></div>", f"{LONG}\nb"),
    ("<article><script>var t='</p><p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes</p", "yes"),
    ("<article><p>a &lt;b&gt; &#233;&#x4E2D; &amp &am", "a <b> é中 & &am"),
    (f"<article><p>{LONG}</p><ul><li><a href=x>one</a><li><a href=y>two</a></ul></article>", LONG),
    (f"<div><h2>Head</h2><p>{LONG}</p><p>so.</p></div><div><p><a href=a>more</a></p><p>so</p></div>", f"Head\n{LONG}\nso."),
    ("<article><p>x < y and 1<2</p><!-- open <p>z</p>", "x < y and 1<2"),
    ('<article><p title="a > b">in</p><p class="ad">out</p><p>in</p></article>', "in\nin"),
    ("<article><header><h1>Title</h1><span>by me</span></header><p>body</p></article>", "Title\nbody"),
])
def test_main_text(page, text):
    assert html_text.main_text(page or "") == text


def plain_article(page):
    """The article of a page of the test tables, by cutting at its tags."""
    import html
    inner = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    cut = [re.sub(r"<[^>]*(>|$)", "", re.sub("<br>", " ", b)) for b in re.split(r"</?(?:p|h1)(?:>|$)", inner.group(1) if inner else "")]
    return "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in cut) if t)


def test_pages_of_the_table(spark):
    pages = {p.page_id: p for p in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = QUERIES["op12_html_text"][0](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain_article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_pages_keep_their_columns(spark):
    frame = spark.createDataFrame([(1, None, "<p>a</p>", "t", "x", "y"), (1, "u", None, "t", "x", None), (None, "u", "<p>" + "w " * 300000, "t", "x", "y")],
                                  "page_id long, url string, html string, text string, `a.b` string, made_text string")
    got = html_text.extract(frame)
    assert got.columns == ["page_id", "url", "a.b", "made_text", "text", "n_chars"]
    rows = sorted((r.page_id or 0, r.url or "", r["a.b"], r.n_chars) for r in got.collect())
    assert rows == [(0, "u", "x", 599999), (1, "", "x", 1), (1, "u", "x", 0)]
    assert html_text.extract(frame.limit(0)).count() == 0


# --- audit ----------------------------------------------------------------------------------

def plain_audit(docs, labels):
    good = {k for k, q, _ in labels if q == 1} - {None}
    toxic = {k for k, _, t in labels if t == 1} - {None}
    texts = {}
    for k, t, _ in docs:
        if k is not None:
            texts[t or ""] = min(k, texts.get(t or "", k))
    parts = {}
    for k, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in zip("ABCDE", [len(words) < 200, 100 * len(set(words)) < 50 * len(words),
                                               100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t),
                                               k is not None and k > texts[t]]) if bad}
        parts.setdefault(lang or "", []).append((k, fails))
    out = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order):
                now = [r for r in left if f in r[1]]
                gone = [r for r in rows if set(order[:step]) & r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(now)
                out[part, order, step + 1] = [len(left), len(now), sum(f in r[1] for r in gone), sum(r[1] == {f} for r in rows),
                                              sum(r[0] in good for r in now), sum(r[0] in toxic for r in now)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audit_rows(frame):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
            for r in frame.collect()}


def test_audit_equals_a_plain_one(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(["a", "Be", "c$", "dé", f"w{rnd.randrange(300)}"]) for _ in range(n)) for n in (0, 1, 199, 200, 201, 500)]
    texts += ["\x1c", " a\x0b", "漢" * 210, "X", None, " ".join(f"v{k}" for k in range(230)), "\n".join(["q"] * 400)]
    docs = [(rnd.choice([k, k, 3, None]), rnd.choice(texts), rnd.choice(["en", "de", "", None])) for k in range(150)]
    labels = [(rnd.choice([k, None]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for k in range(150)] + [(5, 1, 1), (5, 0, 0)]
    frame = (spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
             .withColumn("fails", F.lit("x")).withColumn("part", F.lit("y")).withColumn("a.b", F.lit(1)))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audit_rows(filter_audit.audit(frame, marks)) == plain_audit(docs, labels)
    assert filter_audit.audit(frame.limit(0), marks).count() == 0
    assert filter_audit.audit(awkward(spark).withColumnRenamed("key", "lang"), marks.limit(0)).count() == 600


def test_matrix_of_terms(spark):
    import numpy as np
    rows = [(k, t) for k, t in enumerate(["b a b", None, "", "c  a\tc", "a", "b a b"])]
    docs = spark.createDataFrame(rows, "doc_id long, body string").withColumn("shard", F.lit("clash")).repartition(3)
    matrix, dictionary = term_matrix.document_terms(docs, "body", size=1)
    words = {r.term_id: r.word for r in dictionary.collect()}
    assert sorted(words.values()) == ["a", "b", "c"]
    got = {}
    for r in matrix.collect():
        starts, terms, counts = (np.frombuffer(x, t) for x, t in ((r.indptr, np.int64), (r.terms, np.int64), (r.counts, np.int32)))
        for k, doc in enumerate(r.docs):
            own = slice(starts[k], starts[k + 1])
            assert (np.diff(terms[own]) > 0).all()
            got[doc.doc_id] = {words[t]: int(n) for t, n in zip(terms[own], counts[own], strict=True)}
    assert got == {0: {"a": 1, "b": 2}, 1: {}, 2: {}, 3: {"a": 1, "c": 2}, 4: {"a": 1}, 5: {"a": 1, "b": 2}}
    empty, none = term_matrix.document_terms(nothing(spark))
    assert empty.count() == none.count() == 0


def test_a_shard_encodes_its_texts_batch_by_batch(monkeypatch):
    import numpy as np
    import pyarrow as pa
    texts = [["b a b", None], ["", "c  a\tc"], ["a"]]
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array([{"id": k}] * len(t))], ["text", "doc"])
               for k, t in enumerate(texts)]
    sizes, encode = [], term_matrix.local_rows
    monkeypatch.setattr(term_matrix, "local_rows", lambda t: sizes.append(len(t)) or encode(t))
    monkeypatch.setattr(term_matrix.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    (shard,) = term_matrix.local_shards(batches, 1 << 20, None)
    assert sizes == [2, 2, 1]
    words, starts = shard["words"][0].as_py(), np.frombuffer(shard["indptr"][0].as_py(), np.int64)
    codes, counts = (term_matrix.widen(shard[c][0].as_py(), starts[-1]) for c in ("codes", "counts"))
    assert sorted(words) == ["a", "b", "c"] and len(shard["docs"][0]) == 5
    got = [{words[c]: int(n) for c, n in zip(codes[a:b], counts[a:b], strict=True)} for a, b in itertools.pairwise(starts)]
    assert got == [{"a": 1, "b": 2}, {}, {}, {"a": 1, "c": 2}, {"a": 1}]
