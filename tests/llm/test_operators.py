"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import chat, langid, minhash, mixing, mtree, quality, toxicity, url_filters
from tallyspark.llm.components import components
from tallyspark.llm.sentencepiece_bpe import MergeVocabulary, encode_documents, vocabulary
from tallyspark.llm.token_counts import count_tokens

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, score string, ids string"

HARD_TEXTS = [
    None, "", " ", "\n\t", "   two  spaces   ", "▁mark ▁", "a\x00b", "日本語 😀😀", "é é ﬁ Ǆ", "x" * 3000, " " * 500 + "end" + " " * 90,
    "<s> </s> <unk> <0x0A>", "<|startoftext|> and <|endoftext|>", "it's we'll 12345 --- ...", "one", "one two three four",
    "one two three four five", "same words here again", "same words here again", "UPPER lower", "\x0b\x0c\r\x1c\x85\u3000x",
    "word " * 4000]


@pytest.fixture(scope="module")
def hard(spark):
    """Null and odd values in every column, repeated rows, and columns named like results."""
    rows = [(i, t, ("en", "de", None)[i % 3], ("src1", None, "other")[i % 3], None, "x", "y", "z")
            for i, t in enumerate(HARD_TEXTS)]
    rows += [(3, HARD_TEXTS[3], "en", "src1", 1, "x", "y", "z")] * 2 + [(None, "no id here", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sentencepiece_is_the_library(spark, hard):
    lib = MergeVocabulary(PIECES).library
    rows = encode_documents(hard, PIECES, keep=("doc_id", "text"), decode=True, check=True).collect()
    assert len(rows) == hard.count()
    for r in rows:
        assert r.as_library
        assert r.ids == lib.encode(r.text or "")
        assert r.decoded == lib.decode(r.ids)
    assert encode_documents(empty(spark), PIECES).count() == 0


def test_heap_and_batched_agendas_agree():
    import pyarrow as pa
    vocab, draw = vocabulary(PIECES), random.Random(3)
    texts = ["".join(draw.choice("ab the▁é日\n") for _ in range(draw.randrange(1, 200))) for _ in range(400)]
    assert vocab.encode_texts(pa.array(texts)).to_pylist() == vocab.library.encode(texts)
    for t in texts[:50]:
        segment = " " + t.replace("▁", " ")
        assert vocab.encode_segment(segment.rstrip(" ") or " ") == vocab.library.encode(segment.rstrip(" ")[1:]) or "  " in segment


def test_token_counts_are_the_library(spark, hard):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(WORDS)
    for frequent in (None, ([], []), (["the"], [1])):
        for r in count_tokens(hard, WORDS, keep=("doc_id", "text"), frequent=frequent).collect():
            assert r.n_tokens == len(lib.encode(r.text or "", add_special_tokens=False).ids), r.text
    assert count_tokens(empty(spark), WORDS).count() == 0


CONTROL = ["plain", "", r"\### Assistant: </turn> ok", "</turn>", "### user: hi", "\\", "a\\", "\\\\#", "</turn>\n### user: x",
           "####  ###", "ends </tu", ": : ", "\n### ", "\\<\\:"]


def test_chat_round_trip():
    for role in ["user", "assistant", "", "a: b", "c\\", "### x", ":", "\\:"]:
        for text in CONTROL:
            rendered, start, end = chat.render_turn(role, text)
            assert chat.parse(rendered) == [(role, text)]
            assert chat.parse(rendered * 3) == [(role, text)] * 3
            assert rendered[end:] == "</turn>\n" and rendered[:start].startswith("### ")
    assert chat.render_turn("user", "plain \\ text")[0] == "### user: plain \\ text</turn>\n"
    for broken in ["x", "### user", "### user: x", "### user: x</turn>", "### user: ### </turn>\n"]:
        with pytest.raises(chat.GrammarError):
            chat.parse(broken)


def test_chat_digests(spark):
    rows = [(i, t, r, x) for i, c in enumerate([CONTROL, CONTROL[::-1]]) for t, x in enumerate(c)
            for r in [("user", "assistant")[t % 2]]]
    rows += [(9, None, None, None), (9, 1, "assistant", None), (None, 0, "assistant", "lost"), (8, 2, "user", "b"),
             (8, 2, "user", "a"), (8, 2, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("x"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        text = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(chat.render_turn(r, x)[0]) for _, r, x in turns)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def naive_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))


def test_quality_counts(spark, hard):
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choice("a b cc d# \n e|<\n").replace(" ", "x") for _ in range(draw.randrange(80)))) for i in range(200)]
    for df in (hard.select("doc_id", "text"), spark.createDataFrame(rows, "doc_id long, text string")):
        for r in quality.measure(df.withColumn("n_words", F.lit("x")), keep=("doc_id", "text")).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == naive_counts(r.text)
    assert quality.measure(empty(spark)).count() == 0


def test_quality_bounds_and_verdicts(spark):
    assert quality.binomial_tail(0, 100, 0.05) == pytest.approx(0.95 ** 100)
    assert quality.binomial_tail(3, 10, 0.5) == pytest.approx((1 + 10 + 45 + 120) / 1024)
    assert quality.passes(0, 2000, 0.005, 0.05) and not quality.passes(0, 200, 0.005, 0.05)
    assert not quality.passes(20, 2000, 0.005, 0.05) and not quality.passes(0, 0, 0.5, 0.5)
    draw = random.Random(2)
    rows = [(i, ("en", None)[i % 2], " ".join(f"w{draw.randrange(10**6)}" for _ in range(60)) + (" ###" * 40 if i % 10 == 0 else ""))
            for i in range(8000)]
    measured = quality.measure(spark.createDataFrame(rows, "doc_id long, lang string, text string"), keep=("doc_id", "lang")).cache()
    cutoffs = quality.choose_cutoffs(measured, "lang", F.col("doc_id") % 10 != 0)
    assert set(cutoffs) == {"en", ""} and all("symbols" in c for c in cutoffs.values())
    got = quality.judge(measured, "lang", cutoffs)
    assert got.where("doc_id % 10 = 0 and kept").count() == 0
    assert got.where("doc_id % 10 <> 0 and not kept").count() <= 0.02 * 7200
    assert quality.judge(measured, "lang", {}).where("not kept").count() == measured.where(quality.base_failed()).count()


def test_language_id(spark, hard):
    draw = random.Random(4)
    alphabets = {"aa": "bcdab", "bb": "fghef", "cc": "klmik"}
    text = lambda k: " ".join("".join(draw.choice(alphabets[k]) for _ in range(draw.randrange(2, 7))) for _ in range(30))
    rows = [(i, text(k), k) for i in range(300) for k in [list(alphabets)[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.unionByName(spark.createDataFrame([(1, "zzz", None), (2, None, "aa")], df.schema)))
    assert model.languages == ["aa", "bb", "cc"]
    got = langid.predict(df, model, keep=("lang",)).collect()
    assert all(r.lang == r.lang_pred and 0 < r.score <= 1 for r in got)
    odd = langid.predict(hard, model, keep=("doc_id", "text", "score")).collect()
    assert len(odd) == hard.count() and odd[0].__fields__ == ["doc_id", "text", "lang_pred", "score"]
    for r in odd:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    nothing = langid.fit(empty(spark))
    assert {r.lang_pred for r in langid.predict(hard, nothing).collect()} == {"und"}


def test_bloom_masks_hold_every_gram():
    grams = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    languages = np.arange(5000) % 70
    made = langid.MaskFilter.build([f"l{i:02}" for i in range(70)], grams, languages)
    masks = made.masks(grams)
    assert all((masks[k // 64, i] >> np.uint64(k % 64)) & np.uint64(1) for i, k in enumerate(languages))
    other = made.masks(np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64))
    found = np.mean([((other[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(70)])
    assert found == pytest.approx(made.false_rates().mean(), abs=0.002)


def test_toxicity_learns_from_positives_and_unlabelled(spark, hard):
    draw = random.Random(6)
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        words = [f"w{draw.randrange(400)}" for _ in range(40)] + (["vileword", "badname"] if toxic else [])
        draw.shuffle(words)
        rows.append((i, " ".join(words)))
        if toxic and i % 16 == 0 or not toxic and i % 5 == 0:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((s >= 0.7) == (i % 8 == 0) for i, s in scores.items())
    odd = toxicity.score(hard, model, keep=("doc_id", "text")).collect()
    assert len(odd) == hard.count() and all(0 <= r.score < 0.7 for r in odd)
    assert toxicity.score(docs, model, below=0.7).count() == sum(i % 8 != 0 for i in range(1500))
    untaught = toxicity.fit(docs, marks.limit(0))
    assert toxicity.score(docs, untaught).where("score >= 0.01").count() == 0
    assert toxicity.score(empty(spark), untaught).count() == 0


def naive_sets(texts):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(words[i:i + 5]) for i in range(max(len(words) - 4, min(1, len(words))))})
    return out


def naive_roots(edges, ids):
    root = {i: i for i in ids}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates_by_brute_force(spark):
    draw = random.Random(7)
    word = lambda: f"w{draw.randrange(3000)}"
    passage = [word() for _ in range(40)]
    texts = [None, "", "one two", "ONE two", "one two three"]
    for _ in range(25):
        base = [word() for _ in range(draw.choice((6, 30, 120, 300)))]
        for _ in range(draw.randrange(1, 9)):
            copy = list(base)
            for _ in range(draw.randrange(0, 1 + len(base) // 25)):
                copy[draw.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(passage + [word() for _ in range(draw.randrange(5, 30))]) for _ in range(60)]
    chain = [word() for _ in range(100)]
    for _ in range(60):  # each near the one before, far from the first
        chain = list(chain)
        chain[draw.randrange(100)] = word()
        texts.append(" ".join(chain))
    texts += [texts[10]] * 20
    draw.shuffle(texts)
    sets = naive_sets(texts)
    edges = [(a, b) for a, b in combinations(range(len(texts)), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = naive_roots(edges, range(len(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_shingles", F.lit("x"))
    got = minhash.with_kept(minhash.link(df)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (want[r.doc_id] == r.doc_id) for r in got)


def test_near_duplicates_of_contained_sets(spark):
    """Truncated copies just over the threshold, of sizes whose sketches reach past the middle of the hashes."""
    draw = random.Random(11)
    rows = []
    for i in range(1200):
        longer = draw.randrange(88, 161)
        shorter = draw.randrange(-(-75 * longer // 100), 78 * longer // 100 + 1)
        words = [f"p{i}w{j}" for j in range(longer + 4)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:shorter + 4]))]
    got = {r.doc_id: r.component_id for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = [d for d, c in got.items() if c != d // 2 * 2]
    assert len(got) == len(rows) and not lost, f"{len(lost)} of 1200 links lost"


def test_near_duplicates_odd_rows(spark, hard):
    got = minhash.with_kept(minhash.link(hard)).collect()
    assert len(got) == hard.count()
    by = {r.doc_id: r for r in got}
    assert by[18].component_id == 17 and not by[18].kept and by[None].kept and by[0].kept
    assert minhash.link(empty(spark)).count() == 0


def test_near_duplicates_last_pass_leaves_out_only_what_sketches_disprove(spark):
    """Sets as plain numbers, so that what is not shared can come first in every sketch."""
    rnd = np.random.default_rng(5)
    sets = {}
    for i, (common, only) in enumerate([(343, 57), (342, 57), (86, 14), (85, 15), (48, 16), (1000, 166), (20, 0)]):
        for first in (True, False):  # the values of one side alone are the smallest, or anywhere
            values = rnd.choice(1 << 60, common + 2 * only, replace=False)
            if first:
                values = np.sort(values)[::-1]
            sets[4 * i + 2 * first] = set(values[:common + only].tolist())
            sets[4 * i + 2 * first + 1] = set(values[:common].tolist()) | set(values[common + only:].tolist())
    classes = spark.createDataFrame([(i, len(v), sorted(v)[:minhash.SKETCH]) for i, v in sets.items()],
                                    "id long, n long, sketch array<long>")
    pairs = [(a, b) for a in sets for b in sets if b < a]
    kept = {tuple(r) for r in minhash._possible(spark.createDataFrame(pairs, "a long, b long"), classes).collect()}
    alike = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert alike <= kept
    estimated = {tuple(r) for r in minhash._likely(spark.createDataFrame(sorted(alike), "a long, b long"), classes).collect()}
    assert (3, 2) in alike - estimated
    # Short sets that share nothing are left out without a look at their whole sets.
    assert not {(a, b) for a, b in kept if len(sets[a]) < 300 and a // 2 != b // 2}


def test_components(spark):
    draw = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 150)] + [(500, 500 + draw.randrange(100)) for _ in range(80)]
    edges += [(draw.randrange(200, 300), draw.randrange(200, 300)) for _ in range(60)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = {x for e in edges if e[0] != e[1] for x in e}
    assert got == naive_roots(edges, ids)


def test_top_k_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE_ROWS", 120)
    monkeypatch.setattr(mtree, "LEAF_ROWS", 8)
    monkeypatch.setattr(mtree, "FANOUT", 4)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 5)
    draw = np.random.default_rng(9)
    vectors = [list(map(float, v)) for v in draw.normal(size=(500, 6)).round(2)]
    vectors += [vectors[0]] * 40 + [[0.0] * 6] * 9
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1050, [1.0, None, 2.0]), (1100, [float("nan")] * 6), (1150, [float("inf")] + [0.0] * 5), (None, vectors[3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    whole = np.floor(np.array(vectors) * 256).astype(int)
    want = []
    for q in range(0, len(vectors), 25):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(len(vectors)), -scores)) if i != q][:5]
        want += [(q, r + 1, int(i), int(scores[i])) for r, i in enumerate(order)]
    got = mtree.top_k(df, F.col("vec_id") % 25 == 0).collect()
    assert sorted(map(tuple, got)) == want
    assert [tuple(r) for r in mtree.top_k(df.where("vec_id < 3"), F.col("vec_id") == 1).orderBy("rank").collect()][1:] == \
        sorted([(1, 2, *min(((0, int(whole[0] @ whole[1])), (2, int(whole[2] @ whole[1]))), key=lambda x: x[1]))])
    assert mtree.top_k(df.limit(0), F.lit(True)).count() == 0 and mtree.top_k(df, F.lit(False)).count() == 0


def naive_judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_filters.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)
    return host, path, best


def test_url_rules_and_templates(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Org", "http://a.ORG/", "x://org/es/1", "http://example.org/es/9",
            "http://example.org/es", "http://m.example.org/en/12", "http://m.example.org/en/2", "http://notexample.org/es/1",
            "http://a.com/fr/1?x=/de/", "http://b.com/de/#y", "http://c.net/de/1", "http://d.net?q/a", "http://e.net#/a/b", "a://b://c/d"]
    urls += [f"http://shop.net/spam/{i}" for i in range(60)] + [f"http://shop.net/news/{i}.html" for i in range(60)]
    urls += [f"http://blog.net/{chr(97 + i % 26)}{chr(97 + i // 26)}x/post" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    bad = F.when(F.col("url").contains("shop.net"), F.col("url").contains("/spam/"))
    got = url_filters.judge_urls(df, url_filters.RULES, bad).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule = naive_judge(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text), urls[r.page_id]
        spam = "/spam/" in (urls[r.page_id] or "")
        assert r.verdict == (rule.verdict if rule else "block" if spam else "allow")
    templates = {r.template for r in got if r.host == "blog.net"}
    assert templates == {"/{*}/post"}
    assert url_filters.judge_urls(df.limit(0), url_filters.RULES, bad).count() == 0


def test_subdomains_of_a_site_are_pooled(spark):
    """Six bad pages on each of two hosts of a site are enough."""
    urls = [f"http://{sub}.shop.net/offer/{i}" for sub in ("m", "www") for i in range(6)]
    urls += [f"http://www.paper.net/news/{i}" for i in range(100)] + ["http://m.poker.net/x", "http://blog.net/y", "http://www.blog.net/y"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filters.judge_urls(df, (), F.col("url").contains("/offer/")).collect()
    assert len(got) == len(urls)
    assert all((r.verdict == "block") == ("/offer/" in urls[r.page_id]) for r in got)
    assert {r.reason for r in got if r.verdict == "block"} == {"12 of 12 labelled pages are bad, smoothed purity 0.593"}


def naive_templates(pages):
    """(host, template) -> reject by the rules of the tree, on plain lists: pages are (host, path, bad or None)."""
    def segments(path):
        parts = re.sub("[0-9]+", "{n}", path.rstrip("/")).split("/")[1:]
        return tuple(parts) if len(parts) <= url_filters.DEPTH else (*parts[:url_filters.DEPTH - 1], "/".join(parts[url_filters.DEPTH - 1:]))

    rows = [[h, segments(p), segments(p), b] for h, p, b in pages]
    for level in range(url_filters.DEPTH):
        children = Counter((h, s[:level], s[level]) for h, _, s, _ in rows if len(s) > level)
        nodes = defaultdict(list)
        for (h, above, _), n in children.items():
            nodes[h, above].append(n)
        for row in rows:
            h, _, s, _ = row
            if len(s) > level:
                here = nodes[h, s[:level]]
                if (len(here) >= url_filters.MANY_CHILDREN and sum(here) < url_filters.FEW_URLS * len(here)
                        and children[h, s[:level], s[level]] < url_filters.RARE):
                    row[2] = (*s[:level], url_filters.ANY, *s[level + 1:])
    for level in reversed(range(url_filters.DEPTH)):
        count = defaultdict(lambda: [0, 0])
        for h, _, s, b in rows:
            if len(s) > level and b is not None:
                count[h, s][0] += 1
                count[h, s][1] += b
        branches = defaultdict(set)
        for h, _, s, _ in rows:
            if len(s) > level:
                branches[h, (*s[:level], url_filters.MERGED, *s[level + 1:])].add(s)
        new = {}
        for (h, hole), members in branches.items():
            if len(members) > 1:
                n, bad = (sum(count[h, s][k] for s in members) for k in (0, 1))
                for s in members:
                    m, x = count[h, s]
                    rest, pooled = n - m, bad / n if n else 0
                    if not m or not rest or abs(x / m - (bad - x) / rest) <= url_filters.SIMILAR_SIGMAS * (
                            pooled * (1 - pooled) * (1 / m + 1 / rest)) ** 0.5:
                        new[h, s] = hole
        for row in rows:
            row[2] = new.get((row[0], row[2]), row[2])
    labels = [b for *_, b in rows if b is not None]
    prior = sum(labels) / len(labels) if labels else 0.0
    mine = defaultdict(list)
    for h, _, s, b in rows:
        mine[h, s] += [] if b is None else [b]
    rejected = {k: len(v) >= url_filters.LEAST_LABELLED and (sum(v) + url_filters.SMOOTHING * prior) / (len(v) + url_filters.SMOOTHING)
                >= url_filters.REJECT_AT for k, v in mine.items()}
    return {(h, o): ("/" + "/".join(s), rejected[h, s]) for h, o, s, _ in rows}


def test_templates_by_brute_force(spark):
    draw = random.Random(10)
    pages = []
    for _ in range(3000):
        host = draw.choice(["a.net", "b.org", "c.com"])
        kind = draw.choice(["news", "offer", "user", "deep", "odd"])
        path = {"news": f"/news/{draw.randrange(99)}", "offer": f"/{draw.choice(['sale', 'offer', 'deal'])}/{draw.randrange(9)}.html/",
                "user": "/u/" + draw.choice("abcdefgh") + draw.choice("abcdefgh") + "x/" + draw.choice(["post", "list"]),
                "deep": "/a/b/c/" + draw.choice(["d/e", "d", "d/e/f/g"]), "odd": draw.choice(["", "/", "//", "x"])}[kind]
        rate = {"offer": 0.9 if host != "c.com" else 0.2, "user": 0.6, "deep": 0.1}.get(kind, 0.02)
        pages.append((host, path, None if draw.random() < 0.3 else int(draw.random() < rate)))
    pages += [("tiny.net", "/x/1", 1)] * (url_filters.LEAST_LABELLED - 1) + [("none.net", "/y/1", None)] * 30
    df = spark.createDataFrame(pages, "host string, path string, bad int")
    got = {(r.host, tuple(r.segments)): (r.template, r.reject) for r in url_filters.learn_templates(df).collect()}
    assert got == naive_templates(pages)
    assert any(r for _, r in got.values()) and url_filters.ANY in "".join(t for t, _ in got.values())


def test_seed_words_are_whole_words(spark):
    texts = ["Play POKER now", "pokers", "<a href='//x.casino-win.net'>", "adult-x", "adulthood", None, "", "bets."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(url_filters.seeded(F.col("t"))).collect()] == [True, False, True, True, False, None, False, True]


def test_small_strata_are_pooled(spark):
    """Cutoffs against a plain search: large strata alone, small ones together."""
    draw = random.Random(5)
    rows = []
    for lang, n in (("en", 3000), ("de", 700), ("fr", 650), (None, 40)):
        rows += [(lang, draw.randrange(60, 200), draw.randrange(300, 900), draw.choice([0] * 300 + [40]), draw.choice([0] * 80 + [30]), 3,
                  draw.randrange(40), draw.randrange(20)) for _ in range(n)]
    names = quality.COUNTS
    columns = {"n_words": 1, "word_chars": 2, "n_symbols": 3, "n_dup_lines": 4, "n_repeat_words": 5}
    data = [tuple(r[columns[c]] if c in columns else r[6 + i % 2] for i, c in enumerate(names)) + (r[0],) for r in rows]
    df = spark.createDataFrame(data, ", ".join(f"{c} long" for c in names) + ", lang string")
    got = quality.choose_cutoffs(df, "lang", F.lit(True))
    level, share = quality.DELTA / (len(quality.RULES) * 5), quality.ALLOWED / len(quality.RULES)
    want = {}
    for members in (["en"], ["de", "fr", ""]):
        mine = [dict(zip(names, r)) for r in data if (r[-1] or "") in members]
        for rule, (over, under, cutoffs) in quality.RULES.items():
            for c in cutoffs:
                if not quality.passes(sum(m[over] > c * m[under] for m in mine), len(mine), share, level):
                    break
                for m in members:
                    want.setdefault(m, {})[rule] = c
    assert got == want and set(want) == {"en", "de", "fr", ""}
    few = df.where("lang is null")
    assert quality.choose_cutoffs(few, "lang", F.lit(True)) == {}


def water_fill(budget, caps, weights):
    """Exact shares by bisection over the level, as fractions."""
    if budget >= sum(caps):
        return list(caps)
    low, high = 0.0, max(c / w for c, w in zip(caps, weights))
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, mid * w) for c, w in zip(caps, weights)) < budget else (low, mid)
    return [min(c, low * w) for c, w in zip(caps, weights)]


def test_mixing_budgets(spark):
    leaves = [("a", "x", "1", 100), ("a", "x", "2", 5000), ("a", "y", "1", 40), ("b", "x", "1", 9000), ("b", "z", "9", 0), ("c", "x", "1", 10**6)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    weights = {("a",): 2, ("*", "x"): 3, ("c",): 0}
    for total in (0, 1, 777, 5000, 20000, 10**9):
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(df, F.lit(total), weights, 2).collect()}
        cap = {"a": 10280, "b": 18000}
        root = min(total, sum(2 * t for *_, t in leaves))
        a, b = water_fill(root, [cap["a"], cap["b"]], [2, 1])
        x, y = water_fill(a, [10200, 80], [3, 1])
        one, two = water_fill(x, [200, 10000], [1, 1])
        want = {("a", "x", "1"): one, ("a", "x", "2"): two, ("a", "y", "1"): y, ("b", "x", "1"): b, ("b", "z", "9"): 0}
        assert set(got) == set(want)
        for k in want:
            assert abs(got[k] - want[k]) < 3, (total, k)
        assert sum(got.values()) == min(root, 28280)


def test_mixing_takes_the_shortest_prefix(spark, hard):
    draw = random.Random(10)
    rows = [(i, f"d{i % 2}", "l", "s", draw.randrange(0, 50)) for i in range(400)] + [(7, "d1", "l", "s", 30)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long")
    plan = mixing.make_plan(docs, F.lit(9000), {("d0",): 1, ("d1",): 3}, 3, 1)
    got = Counter()
    for r in mixing.apply_plan(docs, plan, 1).collect():
        got[r.doc_id] = max(got[r.doc_id], r.copies)
    for p in plan.collect():
        mine = [r for r in rows if r[1] == p.domain]
        total = sum(r[4] for r in mine)
        assert p.tokens == total and p.epochs == p.budget // total
        rest, want = p.budget - p.epochs * total, {}
        place = lambda i: hashlib.md5(f"1|{p.epochs}|{i}".encode()).hexdigest()
        for i in sorted({r[0] for r in mine}, key=place):
            want[i] = p.epochs + (rest > 0)
            rest -= sum(r[4] for r in mine if r[0] == i)
        assert {i: c for i, c in want.items() if c} == {r[0]: got[r[0]] for r in mine if got[r[0]]}
    odd = mixing.with_levels(hard).withColumn("n_tokens", mixing.count_words(F.col("text")))
    plan = mixing.make_plan(odd, mixing.budget(), {}, 2, 1)
    assert mixing.apply_plan(odd, plan, 1).count() > 0
    none = odd.limit(0)
    assert mixing.apply_plan(none, mixing.make_plan(none, F.lit(5), {}, 2, 1), 1).count() == 0


def test_mixing_weight_zero_below_the_top(spark):
    """What a child of weight 0 can't take goes to its siblings and then to other branches."""
    leaves = [("a", "x", "1", 100), ("a", "y", "1", 10_000), ("b", "x", "1", 9000), ("b", "x", "off", 700)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    weights = {("a", "y"): 0, ("*", "*", "off"): 0}
    for total, want in ((8000, (100, 7900)), (100, (50, 50)), (10**6, (100, 9000))):
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(df, F.lit(total), weights, 1).collect()}
        assert got == {("a", "x", "1"): want[0], ("b", "x", "1"): want[1]}


def test_mixing_keeps_columns_named_like_the_plans(spark):
    rows = [(i, "d", "l", "s", 10, "e", "f", 5) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long, epochs string, last string, budget long")
    plan = mixing.make_plan(docs, F.lit(300), {}, 2, 1)
    taken = mixing.apply_plan(docs, plan, 1)
    assert taken.columns == [*docs.columns, "copies"] and taken.agg(F.sum("copies")).first()[0] == 30
    assert {(r.epochs, r.last, r.budget) for r in taken.collect()} == {("e", "f", 5)}


def test_top_k_with_shared_ids_and_huge_components(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE_ROWS", 8)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 2)
    draw = np.random.default_rng(2)
    rows = [(i, [float(x) for x in draw.integers(-9, 9, 3)]) for i in range(40)]
    rows += [(0, [9.0, 9.0, float(9 + j)]) for j in range(4)] + [(25, rows[25][1])] * 3  # an id with several vectors, equal rows
    huge = [(50, [1e18, 0.0, 0.0]), (51, [1e300, 1.0, 1.0]), (75, [-1e18, 0.0, 0.0])]
    df = spark.createDataFrame(rows + huge, "vec_id long, embedding array<double>")
    distinct = sorted({(i, tuple(int(256 * x) for x in v)) for i, v in rows})
    want = []
    for q, v in distinct:
        if q % 25 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in distinct if i != q))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    got = sorted(map(tuple, mtree.top_k(df, F.col("vec_id") % 25 == 0).collect()))
    assert got == sorted(want) and len(got) == 6 * 5
