"""Operators against plain single-machine versions of their definitions, on the given small tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from passagemill.llm import html_text, line_dedup, mixing, near_dedup, packing, quality, queries, substrings, topk, toxicity

from .conftest import SCHEMA, filler, words


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def copies(spark):
    """A table with a third of its rows near copies of one text, another group of exact copies, and passages shared by many."""
    rows, shared = [], words(50, 70)
    base = words(51, 200).split()
    for i in range(60):
        own = list(base)
        for k in range(i % 6):
            own[(7 * i + 31 * k) % 200] = f"x{i}-{k}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, words(52, 90)) for i in range(40)]
    rows += [(200 + i, words(60 + i, 100 + i) + " " + shared + " " + words(160 + i, 60)) for i in range(40)]
    rows += [(300 + i, words(300 + i, 80)) for i in range(40)]
    return spark.createDataFrame([(i, t, "en", "s", 1) + filler("x") for i, t in rows], SCHEMA).cache()


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("table", ["docs", "copies"])
def test_near_duplicate_classes(request, table):
    table = request.getfixturevalue(table)
    sets = {r["doc_id"]: shingles(r["text"] or "") for r in table.collect()}
    holders = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            holders[s].append(d)
    both = Counter((a, b) for ds in holders.values() for i, b in enumerate(ds) for a in ds[:i])
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, b), n in both.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(table).collect()}
    assert got == {d: find(d) for d in sets}


def test_settled_members_of_a_bucket_are_compared(spark):
    """Thousands in one bucket: copies A of a leader, each with a text B that is like A and not like the leader."""
    base, rows, want = words(71, 300, 10**6).split(), [(0, words(71, 300, 10**6))], set()
    for i in range(1500):
        near, far = list(base), []
        for k in (3 * i % 40, 100 + i % 40):  # two changes in A cost ten shingles
            near[k] = f"x{i}-{k}"
        far = list(near)
        for k in (160, 180, 200, 220, 240, 260):  # six more in B, thirty shingles
            far[k] = f"y{i}-{k}"
        rows += [(2 * i + 1, " ".join(near)), (2 * i + 2, " ".join(far))]
        want.add((2 * i + 1, 2 * i + 2))
    sets = {i: shingles(t) for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    assert all(alike(0, a) and alike(a, b) and not alike(0, b) for a, b in want)
    texts = spark.createDataFrame(rows, "id long, text string")
    signed = texts.selectExpr("id", "text").mapInArrow(near_dedup._signed(26, 5, 5), "id long, bands array<long>, size long, sketch array<long>")
    # One bucket for all, and one more each of which the leader is a member: nothing else joins A and B.
    bands = near_dedup.F.when(near_dedup.F.col("id") == 0, near_dedup.F.array([near_dedup.F.lit(n) for n in (7, 8)])).when(near_dedup.F.col("id") == 1, near_dedup.F.array(near_dedup.F.lit(7), near_dedup.F.lit(8)))
    nodes = signed.withColumn("bands", near_dedup.F.coalesce(bands, near_dedup.F.array(near_dedup.F.lit(7))).cast("array<long>")).cache()
    links = near_dedup.similar_links(texts, nodes).select("a", "b")
    roots = {r["id"]: r["root"] for r in near_dedup.components(links).collect()}
    assert sum(roots.get(i) != 0 for i in sets) <= 3  # but for the chance that a sketch misses a pair


def test_pairs_whose_differing_shingles_repeat(spark):
    """Sets alike by 0.81, with the differing part of each text repeated 20 times."""
    rows = []
    for i in range(60):
        shared = words(2000 + i, 130, 10**6)
        rows += [(2 * i + k, shared + (" " + words(3000 + 2 * i + k, 10, 10**6)) * 20) for k in (0, 1)]
    sets = {i: shingles(t) for i, t in rows}
    assert all(len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8 for i in range(0, 120, 2))
    got = {r["id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in sets}


def test_probminhash_estimates_probability_jaccard():
    draw = np.random.default_rng(0)
    elements = draw.integers(1, 2**62, 300).astype(np.uint64)
    x, y = draw.uniform(0.5, 3, 250), draw.uniform(0.5, 3, 250)
    wx, wy = np.zeros(300), np.zeros(300)
    wx[:250], wy[50:] = x / x.sum(), y / y.sum()
    shared = np.flatnonzero((wx > 0) & (wy > 0))
    exact = sum(1 / np.maximum(wx / wx[i], wy / wy[i]).sum() for i in shared)
    a, b = near_dedup.signatures([elements[:250], elements[50:]], [x, y], 4096)
    assert abs((a == b).mean() - exact) < 0.04


@pytest.mark.parametrize("table", ["docs", "copies"])
def test_repeated_passages(request, table):
    table = request.getfixturevalue(table)
    seen, whole, want = set(), {}, {}
    for d, text in sorted((r["doc_id"], r["text"] or "") for r in table.collect()):
        if text.split() and text in whole:
            want[d] = [(0, len(text), True)]
            continue
        whole[text] = d
        w, spans = text.lower().split(), [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        marked = []
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            if key not in seen:
                seen.add(key)
            elif marked and i <= marked[-1][1]:
                marked[-1][1] = i + 50
            else:
                marked.append([i, i + 50])
        if marked:
            want[d] = [(spans[a][0], spans[b - 1][1], False) for a, b in marked]
    got = defaultdict(list)
    spans = substrings.repeated_spans(table).collect()
    for r in spans:
        got[r["id"]].append((r["start"], r["end"], r["whole"]))
    assert {d: sorted(v) for d, v in got.items()} == want
    kept = {r["doc_id"]: r["text"] for r in substrings.without_spans(table, table.sparkSession.createDataFrame(spans)).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    for d, cuts in want.items():
        expect, at = "", 0
        for a, b, _ in cuts:
            expect, at = expect + texts[d][at:a], b
        assert kept[d] == expect + texts[d][at:]


def test_line_runs_levels_and_result(copies, spark):
    lines = [(i, "\n".join(f"a line of text number {k}" for k in range(i % 7)) + f"\nOnly in {i}, and quite long \n short ", "en", "s", 1) + filler("x") for i in range(60)]
    table = spark.createDataFrame(lines, SCHEMA)
    runs = line_dedup.build_runs(table, 5, 20, fan_in=2)
    assert [len(level) for level in runs.levels] == [1, 0, 1]  # five batches, written in twos
    fresh = spark.createDataFrame([("not there yet, I am sure",)], "key string").select(*[h.alias(n) for h, n in zip(line_dedup.hash_pair(line_dedup.F.col("key")), ("h1", "h2"))])
    assert runs.unseen(fresh).count() == 1 and runs.unseen(runs.read()).count() == 0
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    holders = defaultdict(set)
    for r in lines:
        for line in r[1].split("\n"):
            holders[line.strip(strip).translate(lower)].add(r[0])
    for batches in (1, 3):
        out = {r["d"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(table, batches=batches).selectExpr("doc.doc_id as d", "n_lines", "n_dropped", "kept_text").collect()}
        for r in lines:
            all_lines = r[1].split("\n")
            stay = [x for x in all_lines if len(k := x.strip(strip).translate(lower)) < 20 or len(holders[k]) < 3 or r[0] == max(holders[k])]
            assert out[r[0]] == (len(all_lines), len(all_lines) - len(stay), "\n".join(stay))


def test_packing_round_trip(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    capacity = 512
    placed = packing.pack_documents(docs, queries.tokenizer_path(), capacity, with_ids=True).cache()
    rows = placed.collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for d, text in texts.items():
        parts = sorted(by_doc[d], key=lambda r: r["piece"])
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in parts]).tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids + [packing.END_ID]
        assert all(r["length"] == capacity for r in parts[:-1])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= -(-total // capacity) * 1.02 + 1
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(placed).collect()}
    for s, parts in by_sequence.items():
        assert whole[s] == b"".join(r["ids"] for r in sorted(parts, key=lambda r: r["offset"]))


def test_word_memory_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer, memory, draw = Tokenizer.from_file(path), packing.WordIds(path, remembered=50), random.Random(1)
    alphabet = "aAéÉ'Σσς.,!$<|>1٣²ªº́ \n\t 你×"
    odd = ["It's DON'T we'll.. 'em", "<|endoftext|> a<|startoftext|>b ab<|endoftext|>.", "J̌ İstanbul ǅ ﬁ ŉ ſ ß ẞ", "x" * 3000, "", " \n", "a\x1cb\x85c"]
    # Every letter with an odd lower case, marks, signs of all kinds, and parts of special tokens.
    hard = [chr(c) for c in range(0xC0, 0x280) if len(chr(c).lower()) > 1 or chr(c).lower().upper() != chr(c).upper()]
    hard += [*"İıſßŉǅǰΐKÅẞﬁ×÷ªº", *"\u0307\u0301\u030c\u0345", *".,;:!?$&#%*()=+/-", *"<|>", "<|endoftext|>", "endoftext", " ", "a", "A", "9", "'s"]
    mixed = ["".join(draw.choice(hard) for _ in range(draw.randint(1, 12))) for _ in range(20_000)]
    every = [before + chr(c) + sign + after for c in range(0xA0, 0x600) for before in ("", "a", "İ") for sign in ".-(" for after in ("", "b")]
    for text in odd + ["AKSARAYLİ, evet"] + mixed + every + ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 40))) for _ in range(2000)]:
        assert memory.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_best_fit_plan_matches_best_fit_decreasing():
    draw = random.Random(3)
    for _ in range(30):
        capacity = draw.choice([10, 50, 64])
        lengths = sorted((draw.randint(1, capacity) for _ in range(draw.randint(0, 300))), reverse=True)
        bins = []
        for length in lengths:
            room = min((b for b in bins if b >= length), default=None)
            if room is None:
                bins.append(capacity - length)
            else:
                bins[bins.index(room)] -= length
        used = defaultdict(int)
        for length, _, n, each, first, _ in packing.plan_slots(Counter(lengths).items(), capacity):
            for i in range(n):
                used[first + i // each] += length
        assert sorted(used.values()) == sorted(capacity - b for b in bins)


def test_quality_base_counts(docs, texts):
    out = quality.judged(docs)
    for r in out.selectExpr("doc.doc_id as d", "*").collect():
        text = texts[r["d"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        times, covered = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
        for i in range(len(w) - 7):
            if times[tuple(w[i : i + 8])] > 1:
                covered.update(range(i, i + 8))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_quality_verdicts_agree_with_labels(spark, docs, data):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [(labels[r["d"]], r["kept"]) for r in quality.judged(docs).selectExpr("doc.doc_id as d", "base_failed", "kept").collect() if r["d"] in labels and not r["base_failed"]]
    good, bad = [k for q, k in rows if q == 1], [k for q, k in rows if q == 0]
    assert sum(good) >= 0.97 * len(good)
    assert not bad or sum(bad) <= 0.4 * len(bad)


def test_mixing_meets_targets(spark, docs, data):
    weights = {"en": 0.25, "de": 0.25, "fr": 0.25, "es": 0.25}
    labels = spark.read.parquet(f"{data}/labels.parquet")
    for keep_all, least in ((False, 0.0), (True, 1.0)):
        rows = mixing.mixed(docs, labels, weights, keep_all=keep_all, least_rate=least).collect()
        totals = defaultdict(float)
        for r in rows:
            assert r["rate"] >= least and abs(r["copies"] - r["rate"]) < 1
            for domain, p in r["posterior"].items():
                totals[domain] += p * r["rate"] * r["n_tokens"]
        share = sum(totals.values()) / 4
        assert all(abs(t - share) < 0.02 * share for t in totals.values()), totals


def test_mixing_by_a_dense_solver(spark, docs, data):
    """Posteriors by a plain loop and rates by a dense solver on 500 documents; shares sum to one; every labelled domain takes part."""
    labels, few = spark.read.parquet(f"{data}/labels.parquet"), docs.limit(500).cache()
    few = few.withColumn("domain", mixing.F.concat("lang", (mixing.F.col("doc_id") % 6).cast("string"))).cache()  # 24 domains
    table = mixing.learned(few, labels, "domain", words_per_domain=4)
    assert len(table.domains) > 16
    rows = few.select("doc_id", "text", table.posterior(quality.words_of(mixing.F.coalesce("text", mixing.F.lit("")))).alias("p")).collect()
    place = {w: i for i, w in enumerate(table.words)}
    for r in rows:
        found = (r["text"] or "").lower().split()
        listed = [w for w in found if w in place]
        scale = min(1.0, mixing.EVIDENCE / max(1, len(found)))
        logs = np.array([prior + scale * (sum(line[place[w]] for w in listed) + (len(found) - len(listed)) * line[-1]) for line, prior in zip(table.logs, table.priors)])
        want = np.exp(logs - logs.max())
        assert abs(sum(r["p"]) - 1) < 1e-9
        if (r["text"] or "").isascii():
            assert np.allclose(r["p"], want / want.sum(), atol=1e-6)

    weights = {"en": 0.4, "de": 0.25, "fr": 0.2, "es": 0.15}
    mixed = mixing.mixed(few, labels, weights).collect()
    names = sorted(weights)
    p = np.array([[r["posterior"].get(d, 0.0) for d in names] for r in mixed])
    t, rates = np.array([r["n_tokens"] for r in mixed], float), np.array([r["rate"] for r in mixed])
    own = (p * t[:, None]).sum(0)
    wanted, dense = np.array([weights[d] for d in names]) * own.sum(), np.ones(len(t))
    for _ in range(2000):
        dense = np.maximum(0, dense - p @ (((p * (dense * t)[:, None]).sum(0) - wanted) / own))
    assert np.abs((p * (rates * t)[:, None]).sum(0) - wanted).max() < 2e-3 * own.sum()
    assert np.abs((p * (dense * t)[:, None]).sum(0) - wanted).max() < 2e-3 * own.sum()
    assert np.abs(rates - dense).max() < 0.02
    gaps = mixing.target_gaps(mixing.mixed(few, labels, weights), weights).collect()
    assert len(gaps) == 4 and all(abs(g["wanted"] - g["reached"]) < 2e-3 for g in gaps)


def test_top_k_ties_and_tiles(spark):
    draw = np.random.default_rng(5)
    matrix = draw.integers(-3, 4, (400, 6)) / 256.0
    vectors = topk.quantised(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id long, embedding array<double>"))
    out = defaultdict(list)
    for r in topk.exact_top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5, shard_rows=32, query_rows=3, cell_rows=100, fan_in=2).orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = np.floor(256 * matrix).astype(int)
    for q in range(0, 400, 50):
        s = whole @ whole[q]
        assert out[q] == sorted(((i, s[i]) for i in range(400) if i != q), key=lambda x: (-x[1], x[0]))[:5]


def test_top_k_beyond_doubles():
    big = np.array([[2**40, 3], [2**40, 1]], np.int64)
    (scores, ids), _ = topk.tile_best(np.array([9, 10]), big[:1].repeat(2, 0) // 2**20, np.array([1, 2]), big, 5)
    assert ids.tolist() == [1, 2] and scores[0] == 2**60 + 0
    with pytest.raises(ArithmeticError):
        topk.tile_best(np.array([9]), big[:1], np.array([1, 2]), big, 5)


def test_toxicity_on_held_out_documents(spark, docs, data):
    insults = "idiot moron scum".split()
    draw = random.Random(2)
    rows = []
    for i in range(600):
        w = words(1000 + i, draw.randint(20, 200), 300).split()
        bad = i % 5 == 0
        for _ in range(draw.randint(3, 8) if bad else 0):
            w[draw.randrange(len(w))] = draw.choice(insults)
        rows.append((i, " ".join(w), int(bad)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.trained(table, table.where("doc_id < 300").select("doc_id", "toxic"))
    assert all(np.diff(model.thresholds) > 0)
    out = {r["doc_id"]: r for r in toxicity.scored(table, model).collect()}
    right = sum(out[i]["toxic"] == bool(bad) for i, _, bad in rows[300:])
    assert right >= 297
    assert all(0 <= r["expected_severity"] <= toxicity.GRADES for r in out.values())


def test_toxic_documents_with_a_single_rare_insult(spark):
    """A tenth are toxic, by one of 400 insults each (more than 256), nearly all of them with a single one."""
    insults = [f"insult{k}" for k in range(400)]
    draw = random.Random(8)
    sets, toxic = [], []
    for i in range(24_000):
        bad = i % 10 == 0
        w = words(5000 + i, 40, 3000).split()
        if bad:
            w[draw.randrange(40)] = insults[i // 10 % 400]
        sets.append(toxicity.word_counts(" ".join(w)))
        toxic.append(int(bad))
    toxic = np.array(toxic)
    model = toxicity.fit(sets[:20_000], toxic[:20_000])
    assert len(model.weights) >= 400
    hit = np.array([model.of_counts(*x) >= model.cut for x in sets[20_000:]])
    assert hit[toxic[20_000:] == 1].mean() >= 0.97 and hit[toxic[20_000:] == 0].mean() <= 2 * toxicity.FALSE_ALARMS
    assert model.held_out["false_alarms"] <= toxicity.FALSE_ALARMS


def test_cut_off_finds_most_at_the_stated_false_alarms():
    p, toxic = np.array([0.01] * 990 + [0.02] * 6 + [0.2] * 4 + [0.1] * 20 + [0.9] * 80), np.array([0] * 1000 + [1] * 100)
    cut = toxicity.best_cut(p, toxic, 0.005)
    assert 0.02 < cut <= 0.1 and toxicity.best_cut(p, toxic, 0.0) > 0.2


PAGES = [
    ("<body><div class='navbar'><ul><li><a href='/'>Home</a><li><a href='/x'>News</a></ul></div><div id='main-content'><h1>A day out</h1><p>We walked a long way &amp; came back late in the evening.<p>It rained, but nobody minded the rain at all.</div>"
     "<div class='sidebar'><h3>Related</h3><p>Ten other stories that you should read.</p></div><div class='cookie-notice'>We use cookies to improve this site. <a>OK</a></div></body>",
     "A day out\nWe walked a long way & came back late in the evening.\nIt rained, but nobody minded the rain at all."),
    ("<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><header>Site name</header><article><h1>Title</h1><p>First   paragraph of the\n text, long enough to be one.</p><aside class='advert'>Buy now, only today.</aside>"
     "<p>Second paragraph <b>with</b> <a href='#'>a link</a>, and more words.</p></article><section id='comments'><p>Nice post, I liked it very much indeed.</p></section><form><p>Subscribe to our letter</p></form><footer>&copy; 2020</footer>",
     "Title\nFirst paragraph of the text, long enough to be one.\nSecond paragraph with a link, and more words."),
]


def test_main_text_of_hand_written_pages(spark, data):
    model = html_text.trained(spark.read.parquet(f"{data}/pages.parquet"))
    for page, text in PAGES:
        assert model.extract(page) == text


BODY, TEXT = PAGES[0]
MOVED = "<p>It rained, but nobody"


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><meta charset=utf-8>" + BODY,
        "<head><title>T</title>" + BODY.removeprefix("<body>"),
        "<head>\n<link rel=x>\n" + BODY.replace("<div class='navbar'>", "<div class='navbar' data-y='12.5'>").replace("<p>", "<p data-y='0'>"),
        *(BODY.replace(MOVED, f"<{tag} class='x'>{MOVED}") for tag in "svg select button canvas object audio video".split()),
        *(BODY.replace(MOVED, f"<{tag} class='x'><p>Not to be read.</p></{tag}>{MOVED}") for tag in "svg button canvas object audio video".split()),
        BODY.replace(MOVED, f"<video src=a>{MOVED}").replace("</h1>", "</h1><video src=b><p>Not to be read.</p></video>"),
        BODY.replace(MOVED, f"<video src=b><p>Not to be read.</p></video>{MOVED}").replace("</h1>", "</h1><video src=a>"),
    ],
)
def test_omitted_end_tags_and_labels_of_others(spark, data, page):
    model = html_text.trained(spark.read.parquet(f"{data}/pages.parquet"))
    assert model.extract(page) == TEXT


LATER = "<p>Second words of a text, long enough to be kept.</p>"
TOLD = "Second words of a text, long enough to be kept."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>See <a class='related'>the study</a> for <span class='author'>Ann</span> and more words.</p>", "See the study for Ann and more words."),
        ("<article><p>Words <b class='promo'>in bold</b> and <i id=ad>more</i>.</p><p><span class='advert'>Only an advert is in this one</span></p></article>", "Words in bold and more."),
        ("<body><p title=it's>First words of a text, long enough.</p>" + LATER, "First words of a text, long enough.\n" + TOLD),
        ('<body><p data-x=a"b>First words of a text, long enough.</p>' + LATER, "First words of a text, long enough.\n" + TOLD),
        ('<body><p data-x="a>b" title = \'c>d\' hidden=>First words of a text, long enough.</p>' + LATER, "First words of a text, long enough.\n" + TOLD),
        *((f"<body><p>First words of a text, long enough.</p><{tag}>hidden words are here" + LATER, "First words of a text, long enough.\n" + TOLD) for tag in ("noscript", "iframe src=x", "template")),
        ("<body><template>a hidden<template>inner words</template>outer hidden words are here, long enough</template>" + LATER, TOLD),
        ("<body><template><p>hidden words</p><template><p>inner words, also hidden</p></template><p>outer hidden words are here</p></template>" + LATER, TOLD),
        ("<head><noscript><iframe src=x></iframe><p>Hidden words, long enough.</p></noscript><title>t</title></head><body>" + LATER, TOLD),
    ],
)
def test_inline_names_quotes_and_open_elements(spark, data, page, text):
    model = html_text.trained(spark.read.parquet(f"{data}/pages.parquet"))
    assert model.extract(page) == text


@pytest.mark.parametrize("unit", ["<div>", "<b>", "<svg>", "<select>", "<noscript>", "<p>", "<table>", "<a class=menu>", "</div>", "<p title=it's>", "<", "&am", "<svg></svg><p>"])
def test_long_hostile_pages_take_time_in_proportion(unit):
    model = html_text.fit(html_text.layouts(*html_text.training_texts([]), 7))
    begun = time.time()
    model.extract(unit * (1_000_000 // len(unit)) + LATER)
    assert time.time() - begun < 15  # in proportion: a few seconds here


def test_text_ends_an_open_head():
    assert [n.text for n in html_text.parse("<head><title>T</title> Plain words<p>More") if n.text] == ["Plain words", "More"]


def test_main_text_of_given_pages_and_held_out_layouts(spark, data):
    pages = [r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    model = html_text.trained(spark.read.parquet(f"{data}/pages.parquet"))
    for page in pages:
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        blocks = [" ".join(html_text.html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert model.extract(page) == "\n".join(b for b in blocks if b)
    wrong = total = 0
    for page in html_text.layouts(*html_text.training_texts(pages), seed=99, copies=3):
        nodes, y = html_text.labelled(page)
        hit = (model.marginals(nodes) >= 0.5) == (y == 1)
        leaf = np.array([n.tag == "#text" for n in nodes])
        wrong, total = wrong + (~hit & leaf).sum(), total + leaf.sum()
    assert wrong <= 0.02 * total


def test_tree_marginals_match_enumeration():
    nodes = html_text.parse("<body><div><p>One text.</p><p>Two</p></div><nav>Three</nav></body>")
    draw = np.random.default_rng(1)
    model = html_text.TreeModel(draw.normal(size=len(html_text.FEATURES)), draw.normal(size=(html_text.EDGE_KINDS, 2, 2)))
    place, own = {id(n): i for i, n in enumerate(nodes)}, html_text.features(nodes) @ model.weights
    weight = np.zeros((len(nodes), 2))
    for state in range(1 << len(nodes)):
        y = [(state >> i) & 1 for i in range(len(nodes))]
        score = sum(own[i] * y[i] for i in range(len(nodes)))
        score += sum(model.edge[html_text.edge_kind(n)][y[place[id(n.parent)]]][y[i]] for i, n in enumerate(nodes) if n.parent)
        for i, s in enumerate(y):
            weight[i, s] += np.exp(score)
    assert np.allclose(model.marginals(nodes), weight[:, 1] / weight.sum(1))


def test_sha_of_kept_text(spark, data, texts):
    rows = queries.op3_line_dedup(spark, data).collect()
    for r in rows:
        if r["n_dropped"] == 0:
            assert r["kept_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_prefix_filter_loses_no_similar_pair(spark, threshold):
    """Families of sets of many sizes, some with common rare shingles: every similar pair of unlike roots comes out."""
    draw, sets = np.random.default_rng(21), {}
    for family in range(12):
        base = draw.choice(10**6, draw.integers(1, 120), replace=False)
        for _ in range(25):
            kept = base[draw.random(len(base)) > draw.choice([0, 0.02, 0.1, 0.3])]
            own = draw.choice(10**6 if family % 2 else 300, draw.integers(0, 1 + len(base) // 5), replace=False) + 2 * 10**6
            some = np.unique(np.concatenate([kept, own]))
            if len(some):
                sets[len(sets)] = some.astype(np.uint64)
    rows = [(i, len(s), s.tobytes()) for i, s in sets.items()]
    members = [(i, i // 3, bool(draw.random() < 0.6)) for i in sets]
    texts = spark.createDataFrame(rows, "id long, size long, shingles binary")
    info = {i: (root, loose) for i, root, loose in members}
    found = near_dedup.overlapping_prefixes(spark.createDataFrame(members, "id long, root long, loose boolean"), texts, threshold)
    got = {tuple(r) for r in found.collect()}
    plain = {i: set(s.tolist()) for i, s in sets.items()}
    want = {(a, b) for a in sets for b in sets if a < b and info[a][0] != info[b][0] and (info[a][1] or info[b][1]) and len(plain[a] & plain[b]) >= threshold * len(plain[a] | plain[b])}
    assert len(want) > 100 and want <= got
    assert all(info[a][0] != info[b][0] for a, b in got) and len(got) < 0.5 * len(sets) ** 2 / 2
