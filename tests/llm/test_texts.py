import glob
import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import chat, decontaminate, mixing, pii, queries, warc
from ledgerlark.llm.common import prepare

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TRICKY = ["é a.b@c.d_e@f.g x@y @z.q a@b a@b. 1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 " + "9" * 9000, "é+1 (234) 555-1234. +12+3456789012 4111 1111 1111 1111 4111-1111-1111-1111 +1((((2 " + "a." * 3000 + "@b.c" + ".d" * 3000,
          "😀 4111111111111111 1.1.1.1", "a%b@c.dd%e@f.gg..h@i.j", ".".join(["1"] * 900)]


def spans(x):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, x or ""):
            d = re.sub("[^0-9]", "", m[0])
            twice = [int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))]
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 12 <= len(d) <= 19 and sum(twice) % 10 == 0, "phone": lambda: 9 <= len(d) <= 15}
            if good[kind]():
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_personal_data_spans_equal_regular_expressions(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(-100 - k, t) for k, t in enumerate(TRICKY)], "doc_id long, text string"))
    want = sorted(hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans(r.text)).encode()).hexdigest() for r in docs.collect())
    rows = pii.report(docs).collect()
    assert sorted(r.base_sha256 for r in rows) == want
    assert pii.report(no_docs).count() == 0
    masked = pii.mask(odd_docs)
    assert masked.columns == odd_docs.columns and masked.count() == odd_docs.count()
    assert not [r for r in masked.select("text").collect() if any(k == "email" for _, _, k, _ in spans(r.text))]


def test_patterns_find_unseen_identifiers(spark):
    prepare(spark)
    rows = [(i, f"note {i} card no: 4111111111111111 end") for i in range(3)]
    for i, card in enumerate(("4111111111111111", "5500005555555559", "4012888888881881", "4222222222222")):
        rows.append((10 + i, f"some words account = {card} more"))
    rows += [(30, "here account = ZX99-8812-QQ7 follows"), (31, "nothing like ZX99-8812-QQ7 here"), (32, "4012888888881881 alone")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[30] == "id:15:28" and got[31] == ""


def test_identifiers_whatever_the_place_of_their_digit(spark):
    prepare(spark)
    cards = ("4111111111111111", "5500005555555559", "4012888888881881", "4222222222222", "378282246310005", "6011111111111117", "5105105105105100", "30569309025904")
    rows = [(i, f"some words account = {card} more") for i, card in enumerate(cards)]
    tokens = ["A1bcdefg", "abcdef1h", "Abcdefg1", "x" * 41 + "7", "y" * 3000 + "7z"]
    rows += [(10 + i, f"here account = {t} ends") for i, t in enumerate(tokens)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    for i, t in enumerate(tokens):
        assert got[10 + i] == f"id:15:{15 + len(t)}" and masked[10 + i] == "here account = [ID] ends", t


def test_benchmark_items_do_not_hide_one_another():
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    long, shorts = letters(120), {n: letters(n) for n in (13, 26, 38, 53, 62, 79)}
    edited = list(long[20:100])
    for p in (10, 21, 32, 44, 55, 66):  # leaves the 25 q-grams that the lemma asks for
        edited[p] = "#"
    docs = [letters(60) + "".join(edited) + letters(60)]
    for n, t in shorts.items():
        part = list(t)
        for k in range(decontaminate.budget(n)):
            part[(k + 1) * n // (decontaminate.budget(n) + 1)] = "#"
        docs.append(letters(60) + "".join(part) + letters(60))
    items = [(0, long), *shorts.items()]
    alone = {(d, i) for i, t in items for d, *_ in decontaminate.Index([(i, t)]).find(docs)}
    assert alone == {(0, 0), *((k + 1, n) for k, n in enumerate(shorts))}
    for some in ([items[0], *items[k : k + 1]] for k in range(1, len(items))):
        index = decontaminate.Index(some)
        assert {(d, index.ids[i]) for d, i, *_ in index.find(docs)} == {x for x in alone if x[1] in index.ids}, index.ids
    index = decontaminate.Index(items)
    assert {(d, index.ids[i]) for d, i, *_ in index.find(docs)} == alone


def test_benchmark_passages(spark, sf, odd_docs, no_docs):
    bench = prepare(spark).read.parquet(f"{sf}/benchmark.parquet")
    items, rng = [(r.item_id, decontaminate.normal(r.text)) for r in bench.collect()], random.Random(5)
    rows, planted = [], set()
    for k in range(40):
        item, text = rng.choice(items)
        a = rng.randrange(max(1, len(text) - 79))
        part = list(text[a : a + 80].upper())
        for _ in range(rng.randrange(7)):
            p = rng.randrange(1, len(part) - 1)
            part[p : p + 1] = rng.choice([["X"], [], [part[p], "Y"]])
        rows.append((1000 + k, "lead in " + "".join(part) + " and out"))
        planted.add((1000 + k, item))
    rows += [(2000 + k, text[:40]) for k, (_, text) in enumerate(items)]  # half a window is no leak
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert planted <= found and not [d for d, _ in found if d >= 2000]
    docs = {r.doc_id: decontaminate.normal(r.text) for r in odd_docs.collect() if r.doc_id is not None}
    want = {(d, i) for d, t in docs.items() for i, b in items if b in t}
    assert want <= {(r.doc_id, r.item_id) for r in decontaminate.matches(odd_docs, bench).collect()}
    left = decontaminate.remove(odd_docs, bench)
    assert left.columns == odd_docs.columns and not {r.doc_id for r in left.collect()} & {d for d, _ in want}
    assert decontaminate.matches(no_docs, bench).count() == 0 and decontaminate.matches(odd_docs, bench.filter("false")).count() == 0


def test_mix_meets_targets(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    words = sorted((r.doc_id or 0, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in odd_docs.select("doc_id", "text").collect())
    assert sorted((r.doc_id or 0, r.size) for r in rows) == words
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    names = sorted(by, key=lambda s: (s is None, s))
    size, weight, total = {s: sum(r.size for r in by[s]) for s in names}, {s: float(1 + k % 3) for k, s in enumerate(names)}, sum(r.size for r in rows)
    target, capped = {}, set()
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        target = {s: 3.0 * size[s] if s in capped else level * weight[s] for s in names}
        more = {s for s in names if target[s] > 3 * size[s]}
        if not more:
            break
        capped |= more
    for s in names:
        assert by[s][0].target == pytest.approx(target[s]) and by[s][0].source_size == size[s]
        assert abs(sum(r.taken for r in by[s]) - target[s]) <= 1
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert all(0 <= p <= total for r in rows for p in r.positions) and all(len(r.positions) <= 3 for r in rows)
    again = mixing.mix(odd_docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    order = [r.position for r in mixing.schedule(mixing.mix(odd_docs)).collect()]
    assert order == sorted(order)
    assert mixing.mix(no_docs).count() == 0


def test_training_order_is_written_and_rows_follow_it(spark, sf, odd_docs, no_docs):
    prepare(spark)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/mixing-test-{random.random()}"
    rows = mixing.deal(odd_docs, path).collect()
    want = mixing.mix(odd_docs).drop("place").collect()
    assert sorted(map(str, rows)) == sorted(map(str, want)) and max(len(r.positions) for r in rows) > 1
    order = [r for f in sorted(glob.glob(f"{path}/order/part-*.parquet")) for r in pq.read_table(f).to_pylist()]
    assert [r["position"] for r in order] == sorted(p for r in rows for p in r.positions)
    assert sorted((r["doc_id"] or 0, r["position"]) for r in order) == sorted((r.doc_id or 0, p) for r in rows for p in r.positions)
    assert mixing.deal(no_docs).count() == 0
    got = queries.QUERIES["op2_curriculum_mix"](spark, sf).collect()
    assert max(len(r.positions) for r in got) > 1 and all(r.first_position == (r.positions or [None])[0] for r in got)


def test_archive_round_trip(spark, sf):
    pages = prepare(spark).read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    big = "x" * 1500
    pages = pages.union(spark.createDataFrame([(-1, None, None), (-2, "u\r\nX: y", ""), (-3, "u", big), (-4, "u", big), (-5, "u", "é" * 499), (-6, "u", "é" * 499), (None, "u", big), (-7, "u", "é" * 500), (-8, "u", "é" * 500)], "page_id long, url string, html string"))
    path = f"{spark.conf.get('spark.checkpoint.dir')}/warc-test-{random.random()}"
    got = {r.page_id: r for r in warc.archive_pages(pages, path).collect()}
    con = duckdb.connect()
    frame = pages.filter("page_id is not null").toPandas()
    con.register("pages", frame)
    for page, n, digest, kind, refers in con.sql(warc.ORACLE).fetchall():
        assert (got[page].payload_bytes, got[page].payload_digest, got[page].record_type, got[page].refers_to) == (n, digest, kind, refers), page
    assert got[-4].record_type == "revisit" and got[-4].refers_to == -3 and got[-5].record_type == "response" and got[None].record_type == "response"
    texts = {r.page_id: r.html for r in pages.collect()}
    for r in warc.read_records(spark, path).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
        assert body[:-4] == ((texts[r.page_id] or "").encode() if r.kind == "response" else b"")
    assert spark.read.parquet(f"{path}/payloads").count() == len({(t or "") for t in texts.values()})
    assert warc.archive_pages(pages.filter("false")).count() == 0


def test_chat_round_trip(spark, sf):
    own = prepare(spark).read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = [(-2, 0, "system", "sys <|im_end|> <\\|x| <|"), (-3, None, None, None), (-3, 1, "as\\n\n<|sistant", "<<|"), (-4, 0, "system", "only"), (None, 0, "user", "lost")]
    odd += [(-5, i, "assistant" if i % 2 else "user", f"turn {i} é😀 <|im_start|> " * (i % 23)) for i in range(200)] + [(-5, 3, "assistant", "turn 3 é😀 <|im_start|> " * 3)]
    turns = chat.with_probe(own.union(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")))
    want = defaultdict(list)
    for r in turns.collect():
        if r.conv_id is not None:
            want[r.conv_id].append((r.turn is None, r.turn or 0, r.role or "", r.text or ""))
    rows = chat.write_and_read(spark, turns).collect()
    assert {r.conv_id for r in rows} == set(want)
    for r in rows:
        g = sorted(want[r.conv_id])
        said, loss = "".join(f"{x[2]}\n{x[3]}\n" for x in g), "".join(x[3] for x in g if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(g), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()), r.conv_id
    made = chat.windows(turns).collect()
    assert max(r.tokens for r in made if r.conv_id == -5) <= chat.BUDGET and sum(r.conv_id == -5 for r in made) > 5
    assert all(r.text.startswith("<|im_start|>system\n") for r in made if r.conv_id == -2)
    assert chat.windows(turns.filter("false")).count() == 0


def test_found_identifiers_seed_further_patterns(spark):
    """Cards make "account =" a pattern; what it finds makes "badge:" one, in other texts, without any card there."""
    prepare(spark)
    rng = random.Random(3)

    def card():
        digits = [rng.randrange(10) for _ in range(15)]
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits))
        return "".join(map(str, digits)) + str(-total % 10)

    found = [f"ZX{k}9-88{k}2-QQ7" for k in range(8)]
    rows = [(k, f"some words account = {card()} more") for k in range(40)]
    rows += [(100 + k, f"some words account = {t} more") for k, t in enumerate(found)]
    rows += [(200 + k, f"wears badge: {t} today") for k, t in enumerate([*found, "NEW-4411-77"])]
    rows += [(300 + k, f"build number x1234567{k} shipped") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert all(got[100 + k].startswith("id:21:") for k in range(8)) and all(got[200 + k].startswith("id:13:") for k in range(9))
    assert all(got[300 + k] == "" for k in range(9))
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert masked[208] == "wears badge: [ID] today"


def test_long_texts_with_many_matches_and_clashing_names(spark):
    """Running sums in blocks and pieces of chunks give what regular expressions give; names of columns do not matter."""
    prepare(spark)
    text = "".join(f"é u{k}@h{k % 7}.org 10.0.{k % 300}.1 " if k % 3 else f"word{k} " for k in range(3000))
    over = "mail a.b@c.org+4912345678901@d.org and 4111111111111111@x.org end"
    docs = spark.createDataFrame([(1, text), (2, over), (2, over), (3, None), (4, "")], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(c) for c in ("_key", "_spans", "key", "spans", "row", "base")})
    want = {r.doc_id: spans(r.text) for r in docs.collect()}
    for r in pii.report(docs).collect():
        say = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(say.encode()).hexdigest()
    out = pii.mask(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        assert (r["_key"], r["_spans"], r.key, r.spans, r.row, r.base) == ("_key", "_spans", "key", "spans", "row", "base")
        if r.doc_id == 1:
            hidden, at = [], 0
            for a, _, k, b in want[1]:
                hidden += [text[at:a], f"[{k.upper()}]"]
                at = b
            assert r.text == "".join(hidden) + text[at:]
    assert out.filter("doc_id = 2").count() == 2 and out.filter("doc_id = 3 and text is null").count() == 1
