"""Operators for language-model data against brute force, exact round trips and small damaged inputs."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from auditloom.llm.canonical_map import CanonicalList, canonical_codes, edits
from auditloom.llm.eval_leaks import ItemIndex, leaks, words_of
from auditloom.llm.layout_duplicates import collisions, copies, copy_groups
from auditloom.llm.name_variants import NameReader, linked_rows, near_pairs
from auditloom.llm.residue import ResidueModel, fitted, passages, residue


# 3: duplicates hidden by formatting
def test_copies(spark):
    rows = [
        (5, "A b", "X", "y", 1), (2, "a-B!", "x", "Y", 1), (9, "x", "ab", "y", 1), (3, "ab", "x", "y", 2), (4, None, "", "..", 1), (6, "", None, " ", 1), (7, "abx", "", "y", 1),
    ]
    df = spark.createDataFrame(rows, "row bigint, name string, place string, state string, key int").withColumn("hash", F.lit(1))
    args = ("row", ["key"], ["name", "place", "state"])
    assert sorted(map(tuple, copies(df, *args).collect())) == [(2, 5), (2, 9), (4, 6)]
    assert sorted(r["copies"] for r in copy_groups(df, *args).collect()) == [1, 1, 2, 3]
    assert collisions(df, *args).count() == 0 and copies(df.limit(0), *args).count() == 0


def test_exact_columns_do_not_run_together(spark):
    df = spark.createDataFrame([(1, "ab", "c", "n"), (2, "a", "bc", "n"), (3, None, "c", "n"), (4, "", "c", "n")], "row int, k string, l string, n string")
    assert copies(df, "row", ["k", "l"], ["n"]).count() == 0


# 5: name variants
FORMS = [("Robert", "Bob"), ("Katherine", "Kit"), ("Christopher", "Kit"), ("William", "Bill")]
GIVEN = {"robert", "katherine", "christopher", "olga", "orla", "william", "james", "jude"}
PLACES = [("QLH", "Quillhaven"), ("NMW", "North Marrow")]


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [
        ("Robert Marsden", "Marsden, Bob", 2), ("Olga Marsden", "Orla Marsden", 0), ("Robert Marsden", "R. Marsdne", -1), ("Mr Robert Marsden", "ROBERTMARSDEN", 2),
        ("Kit Marsden", "Katherine Marsden", 2), ("Robert J. Marsden", "Robert James Marsden", 2), ("Robert James Marsden", "Robert Jude Marsden", 0),
        ("Thornby Bakery Ltd", "The Thornby Bakery", 2), ("Thornby Bakery Ltd", "Thornby Foundry Ltd", 0), ("B. Marsden", "William Marsden", 1), ("Robert van Marsden", "Marsden Robert", 2),
    ],
)
def test_name_comparison(a, b, expected):
    reader = NameReader(GIVEN, FORMS, [PLACES])
    assert reader.compare(reader.parse(a), reader.parse(b)) == expected


def test_cells_find_every_pair_within_the_radius(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abcd") for _ in range(rng.randint(4, 7))) for _ in range(160)]
    rows = [(1, i, n, len(names), n) for i, n in enumerate(dict.fromkeys(names))]
    df = spark.createDataFrame(rows, "block bigint, f bigint, name string, size bigint, own string")

    def plain(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    truth = {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if plain(a[2], b[2]) <= 2}
    got = [(r["f_a"], r["f_b"]) for r in near_pairs(df, 2, 16).collect()]
    assert len(got) == len(set(got)) and set(got) == truth


def test_linked_rows(spark):
    given = ["Robert", "Katherine", "Christopher", "Olga", "James", "Jude"]
    rows = [(i, f"{g} Surname{chr(97 + k) * 6}", f"z{i}") for i, (k, g) in enumerate(itertools.product(range(8), given), 100)]
    rows += [(1, "Robert Marsden", "z"), (2, "Marsden, Bob", "z"), (3, "R Marsden", "z"), (4, "Olga Marsden", "z"), (5, None, "z"), (6, "Quillhaven", "z"), (7, "robert  marsden", "z")]
    rows += [(8, "J. Petherick", "y"), (9, "James Petherick", "y"), (10, "Jude Petherick", "y"), (11, "Robert Marsdem", None), (12, "Robert Marsden", None)]
    df = spark.createDataFrame(rows, "row bigint, name string, zip string")
    got = sorted(map(tuple, linked_rows(df, "row", "name", [F.col("zip")], FORMS, [PLACES]).collect()))
    assert got == [(1, 2), (1, 3), (2, 3), (2, 7), (3, 7), (11, 12)]
    assert linked_rows(df.limit(0), "row", "name", [F.col("zip")], FORMS, [PLACES]).count() == 0


# 6: canonical list
def test_canonical_list():
    places = CanonicalList([*PLACES, ("SMW", "South Marrow"), ("SOR", "Saint Orrin"), ("LAP", "Lapworth")])
    means = {
        "QLH": "QLH", " qlh.": "QLH", "Borough of North Marrow": "NMW", "N. Marrow": "NMW", "Sth Mrrw": "SMW", "St Orrin": "SOR", "Quilhavne": "QLH", "Q uillhaven West": "QLH",
        "Marrow": None, "Thornby": None, "": None, "...": None, "Quillh.": "QLH", "x" * 50_000: None,
    }
    assert {v: places.match(v) for v in means} == means
    assert CanonicalList([]).match("a") is None
    assert edits("ab", "ba", 2) == 1 and edits("abc", "xyz", 1) == 2


def test_canonical_codes(spark):
    df = spark.createDataFrame([(1, "Quillhaven"), (2, "quillhaven"), (2, "quillhaven"), (3, "N/A"), (4, None), (5, "elsewhere")], "row int, place string").withColumn("code", F.lit("x"))
    got = sorted(map(tuple, canonical_codes(df, "row", {"place": PLACES}).collect()))
    assert got == [(2, "place", "QLH"), (2, "place", "QLH"), (5, "place", "none")]
    assert canonical_codes(df, "row", {"place": []}).filter("code <> 'none'").count() == 0
    assert canonical_codes(df.limit(0), "row", {"place": PLACES}).count() == 0


# 7: tokenizer
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary file")
def test_encoding_equals_the_library_and_decodes_back(spark):
    import public_tokenizers
    import tiktoken

    from auditloom.llm.byte_bpe import ByteBpe, load_ranks

    ranks = load_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "\n\n x\t", "It's 12345 o'clock.", "naïve Übermaß 日本語 🙂🙂", "<|endoftext|> a", "a" * 300, "x  y  z ", "Zwaarlqix Zwaarlqix", "word " * 5000, "don't'll 'S ''s\r\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1))
    bpe = ByteBpe(ranks)
    for most in (2, 1000):
        got = bpe.encode(df, "doc_id", "text", most)
        assert {r["doc_id"]: list(r["ids"]) for r in got.collect()} == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = got.select("doc_id", bpe.decode(F.col("ids")).alias("text")).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


# 8: leaks
def test_leaks_equal_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30)))) for i in range(40)] + [(40, None), (41, ""), (42, "W1, w2; w3")]
    docs = []
    for i in range(200):
        words = [rng.choice([*vocabulary, "other"]) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            own = words_of(items[rng.randrange(40)][1])
            k = rng.randrange(max(1, len(own) - 5))
            words[10:10] = own[k : k + rng.randint(3, 8)]
        docs.append((i, rng.choice([" ", ", ", "\n- "]).join(words).upper()))
    docs += [(900, None), (901, "")]
    run = 5
    grams = lambda t: {tuple(w[k : k + run]) for w in [words_of(t or "")] for k in range(len(w) - run + 1)}
    truth = {(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)}
    assert truth
    a, b = spark.createDataFrame(docs, "doc bigint, text string"), spark.createDataFrame(items, "item bigint, text string")
    for block in (20_000, 15):
        got = list(map(tuple, leaks(a, "doc", "text", b, "item", "text", run, block).collect()))
        assert len(got) == len(set(got)) and set(got) == truth
    assert leaks(a, "doc", "text", b.limit(0), "item", "text").count() == 0 and leaks(a.limit(0), "doc", "text", b, "item", "text").count() == 0
    assert ItemIndex([], 5).leaks("a b c d e f") == []


# 9: residue
CONTENT = [f"The {a} claimed the {b} and the court dismissed the {c} of {n} crowns." for n, (a, b, c) in enumerate(itertools.product(("buyer", "tenant", "agent"), ("kiln", "ledger", "deposit"), ("appeal", "motion", "claim")))]
RESIDUE = ["Please enable JavaScript to view this judgment.", "Something went wrong while fetching the file.", "Lorem ipsum dolor sit amet consectetur.", "Decided: {{date}}", "Before: [INSERT JUDGE]", "Your session has expired. Please sign in again."]
DISCUSSED = ["An exhibit showed a page reading “Please enable JavaScript to view this judgment” and the buyer relied on it.", "Signed: ____________ (left blank)", "[REDACTED] v [...]"]


def test_residue(spark):
    rng = random.Random(2)
    docs = [(i, "\n".join(rng.sample(CONTENT, 8))) for i in range(300)]
    docs += [(1000 + i, "\n".join([*rng.sample(CONTENT, 4), t])) for i, t in enumerate(RESIDUE)] + [(1100 + i, t) for i, t in enumerate(RESIDUE)]
    docs += [(2000 + i, "\n".join([*rng.sample(CONTENT, 4), t])) for i, t in enumerate(DISCUSSED)] + [(3000, None), (3001, ""), (3002, " \n"), (3003, docs[0][1] * 200)]
    df = spark.createDataFrame(docs, "doc bigint, text string").withColumn("doc_id", F.lit(0))
    got = sorted(r["doc_id"] for r in residue(df, "doc", "text").collect())
    assert got == [*range(1000, 1006), *range(1100, 1106)]
    assert residue(df.limit(0), "doc", "text").count() == 0


def found(spark, docs, **kwargs):
    return sorted(r["doc_id"] for r in residue(spark.createDataFrame(docs, "doc bigint, text string"), "doc", "text", **kwargs).collect())


def content(n, rng, lines=8):
    return [(i, "\n".join(rng.sample(CONTENT, lines))) for i in range(n)]


def test_one_placeholder_in_a_corpus_is_found(spark):
    docs = content(100, random.Random(3))
    assert found(spark, docs) == []
    assert found(spark, [*docs, (500, docs[0][1] + "\nBefore: {{judge}}")]) == [500]


def test_frequent_pages_stay_residue(spark):
    docs = content(300, random.Random(4))
    docs += [(1000 + i, f"Please enable JavaScript to view judgment {chr(97 + i % 26)}{i}.") for i in range(60)]
    assert found(spark, docs) == [*range(1000, 1060)]


def test_filler_of_typed_over_letters_is_scored(spark):
    docs = content(100, random.Random(5))
    docs += [(500, docs[0][1] + "\nThe buyer xxxx xxxxxxx xx xxxxx xxx claimed the kiln."), (501, "XXXX XXX XXXXX XXXXXX")]
    docs += [(502, docs[1][1] + "\nThe court, Harrow and Quill JJ, heard XXXXXX v XXXX XXXX, part II.")]
    assert found(spark, docs) == [500, 501]


def test_texts_that_are_not_scored_cannot_be_cases():
    rng = random.Random(6)
    model = ResidueModel({"scripts": 9.0, "wait": 9.0, "turn": 9.0, "kiln": -2.0}, -3.0)
    words = ["scripts", "wait", "turn", "kiln", "court", "“scripts”", "xxxx xxx xxxx xxx", "{{date}}", "l'scripts", "t\xadurn", "please sign in"]
    for _ in range(500):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
        assert model.is_case(text) == any(model.decides(p) for p in passages(text)), text


def test_phrases_that_nobody_listed_are_learnt_at_any_size(spark):
    phrases = ("internal server error", "page not found")
    for n in (60, 600):
        rng = random.Random(n)
        docs = content(n * 10, rng)
        docs += [(100_000 + i, f"{'Internal server error' if i % 2 else 'Page not found'}\nThe registry sleeps until Monday morning.") for i in range(n // 10)]
        docs += [(200_000 + i, "The registry sleeps until Monday morning.") for i in range(n // 10)]
        docs += [(300_000 + i, "\n".join([*rng.sample(CONTENT, 4), "The registry sleeps until Monday morning."])) for i in range(n // 10)]
        source = spark.createDataFrame(docs, "doc_id bigint, text string")
        model = fitted(source, 1, 1000, 2.0, phrases)
        assert {d for d, t in docs if model.is_case(t)} == {d for d, _ in docs if d >= 100_000}


def test_word_sets_of_values_with_many_words():
    places = CanonicalList([*PLACES, ("SMW", "South Marrow")])
    assert places.match("a b c d e f g h i j k l m Nroth Marorw n o p") == "NMW"


def test_every_entry_is_compared():
    entries = [(f"C{i:03}", f"{a}{b}ville {c}") for i, (a, b, c) in enumerate(itertools.product(("Nor", "Sud", "Wes"), ("ana", "eno", "iru", "olo"), ("Green", "Hill", "Abbey Wood")))]
    places = CanonicalList(entries)
    rng = random.Random(8)
    for code, name in entries:
        k = rng.randrange(1, len(name) - 1)
        assert places.match(f"the old place they call {name[:k]}{name[k + 1:]} these days") == code, name
        assert places.match(name[:k] + "q" + name[k:]) == code
    long = CanonicalList([("L", "Upper North Saint Orrin Heights Park Gardens"), ("M", "Lower North Saint Orrin Heights Park Gardens")])
    assert long.match("Upr Nth St Orrin Hts Pk Gdns") == "L"


# 7: long words
@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary file")
def test_long_words_equal_the_library(spark):
    import public_tokenizers
    import tiktoken

    from auditloom.llm.byte_bpe import ByteBpe, load_ranks

    ranks = load_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    texts = ["a" * 6000, "." * 1501, "ß" * 400, "=" * 500 + "-" * 333, "".join(rng.choice("etaoinsrhldcu") for _ in range(32_000)), "日本語" * 200]
    texts += ["".join(rng.choice("etaoin") for _ in range(rng.randint(150, 500))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: list(r["ids"]) for r in ByteBpe(ranks).encode(df, "doc_id", "text", 100).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


# 5: all paths of the linking
def test_large_blocks_are_linked_like_small_ones(spark):
    from auditloom.llm.name_variants import components

    rng = random.Random(10)
    given = ["Robert", "Katherine", "Olga", "James"]
    surnames = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(4)).capitalize() for _ in range(40)]

    def typed(name):
        k = rng.randrange(len(name) - 1)
        return rng.choice([name, name[:k] + name[k + 1] + name[k] + name[k + 2 :], name[:k] + name[k + 1 :], name[:k] + "x" + name[k:]])

    rows = [(i, rng.choice([f"{g} {typed(s)}", f"{typed(s)}, {g}", f"{g[0]}. {s}"]), "z") for i, (g, s) in enumerate((rng.choice(given), rng.choice(surnames)) for _ in range(300))]
    rows += [(1000 + i, f"{g} Surname{chr(97 + k) * 6}", f"z{i}") for i, (k, g) in enumerate(itertools.product(range(8), given))]
    df = spark.createDataFrame(rows, "row bigint, name string, zip string")
    small, large, heavy = ({tuple(r) for r in linked_rows(df, "row", "name", [F.col("zip")], FORMS, [PLACES], cell_size=32, local=n, share=s).collect()} for n, s in ((1000, 0.5), (50, 0.95), (50, 0.1)))
    assert len(small) > 100 and small == large == heavy
    chain = spark.createDataFrame([(1, i, i + 1) for i in range(100)] + [(2, 5, 9), (2, 9, 7)], "block bigint, f_a bigint, f_b bigint")
    assert {(r["block"], r["f"]): r["root"] for r in components(chain).collect()} == {(1, i): 0 for i in range(101)} | {(2, k): 5 for k in (5, 7, 9)}


def test_distance_is_levenshtein():
    from auditloom.llm.name_variants import distance

    rng = random.Random(11)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            last = row
        assert distance(a, b) == last[-1]


def test_pivots_that_do_not_part_names_do_not_multiply_them(spark):
    from auditloom.llm.name_variants import block_pairs, cells

    rng = random.Random(12)
    names = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(4, 8))) for _ in range(2000)]
    df = spark.createDataFrame([(1, rng.getrandbits(63) - 2**62, n, len(names), n) for n in names], "block bigint, f bigint, name string, size bigint, own string")
    placed = cells(df, 4, 64)
    assert placed.filter("home").count() == len(names) and placed.count() <= 3 * len(names)
    # Copies of rows give pairs in pieces, each pair once.
    reader = NameReader(GIVEN, FORMS, [PLACES])
    spelled = ["Robert Marsden", "Marsden, Bob", "Olga Marsden"]
    found = [p for a, b in block_pairs(reader, [i % 3 for i in range(90)], [spelled[i % 3] for i in range(90)], list(range(90))) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert sorted(found) == [(i, j) for i in range(90) for j in range(i + 1, 90) if {i % 3, j % 3} == {0, 1}]


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary file")
def test_encoding_reads_the_texts_once(spark):
    import public_tokenizers
    import tiktoken

    from auditloom.llm.byte_bpe import ByteBpe, load_ranks

    ranks = load_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(13)
    texts = ["".join(rng.choice("aé1 ²½٣𝔸𝟘😀́\n\t'’s日ⅷ​\x85\x1c") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "x" * 70 + " x" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    spark.sparkContext.setJobGroup("encode", "")
    bpe = ByteBpe(ranks)
    bpe.PART = 500
    got = bpe.encode(df, "doc_id", "text", 50)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("encode")
    assert got.dtypes == [("doc_id", "int"), ("ids", "array<int>")]
    assert {r["doc_id"]: list(r["ids"]) for r in got.collect()} == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    damaged = spark.range(1).select("id", F.expr("cast(X'61ff62' as string)").alias("text"))
    assert list(bpe.encode(damaged, "id", "text").first()["ids"]) == library.encode_ordinary("a�b")
