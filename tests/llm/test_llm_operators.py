"""Text operators against brute force and round trips, with the edge cases their docstrings name."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomgraph.functions.visual import fold, visual_key
from loomgraph.llm import encoding, leakage, lookalikes, packing, records, splitting
from loomgraph.llm.lookalikes import plain_key
from tests.llm.sentences import SENTENCES


def test_lookalikes_against_brute_force(spark):
    names = ["Uca Divan", "РАКР 2375", "II dərəcəli seçki", None, ""]
    vals = ["Uca Divan", "uca-divan ", "Uca\u00a0Divan", "Uсa Divan", "PAKP 2375", "ракр 2375", "Ⅱ dərəcəli seçki", "başqa", "Uca​Divan", None, "", "  ", "-", "Uca Divan"] + ["Uca Divan"] * 300
    rows = spark.createDataFrame([(i, v, "k") for i, v in enumerate(vals)], "row_id int, value string, known2 string").repartition(3)
    reg = spark.createDataFrame([(n,) for n in names + names], "name string")
    got = {r.row_id for r in lookalikes.flagged_rows(rows, reg).collect()}
    looks = defaultdict(set)
    for n in names:
        if n:
            looks[visual_key(n)].add(plain_key(n))
    want = {i for i, v in enumerate(vals) if v and visual_key(v) in looks and plain_key(v) not in looks[visual_key(v)]}
    assert got == want and len(want) == 5
    forms = {r.row_id: r.form for r in lookalikes.canonical_rows(rows, reg).collect()}
    assert len(forms) == len(vals) and forms[3] == "Uca Divan" and forms[4] == "РАКР 2375" and forms[9] is None and forms[7] == "başqa"
    assert lookalikes.flagged_rows(rows.limit(0), reg).count() == 0 and lookalikes.flagged_rows(rows, reg.limit(0)).count() == 0


def test_plain_keys_keep_other_characters():
    assert plain_key("Baş-Təftiş  Palatası\n") == plain_key("baş təftiş (palatası)")
    assert plain_key("Uca\u00a0Divan") != plain_key("Uca Divan")
    assert plain_key("Uсa Divan") != plain_key("Uca Divan")


def test_tidy_forms(spark):
    vals = ["Uca Divan", None, "", "Uсa  Divan", "x" * 5000 + "é", "  ", "\u09c7\u09be", "ｕｃａ\u200b"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = {r.s: (r.p, r.t) for r in df.select("s", lookalikes.plain_key_col("s").alias("p"), lookalikes.tidy_col("s").alias("t")).collect()}
    assert got == {v: (None, None) if v is None else (plain_key(v), lookalikes.tidy(v)) for v in vals}
    assert lookalikes.tidy("Uсa  Divan") == "Uca Divan" and lookalikes.tidy("\u09c7\u09be") == "\u09cb" and lookalikes.tidy("ｕｃａ\u200b") == "uca"


def test_records_against_brute_force(spark):
    r = random.Random(2)
    base = [("İcra Divanı", "b", f"r {i}") for i in range(6)]
    spell = [lambda s: s, lambda s: s.upper().replace("ı", "I"), lambda s: f" {s}!", lambda s: s.replace(" ", "-")]
    rows = []
    for i in range(400):
        a = base[0] if r.random() < 0.4 else r.choice(base)
        rows.append((i, *[r.choice(spell[:1] * 3 + spell[2:])(x) for x in a], "extra"))
    rows += [(400, None, "b", "c", ""), (401, " ", "b", "c", ""), (402, "", "", "", ""), (403, "z" * 50000, "b", "c", "")]
    df = spark.createDataFrame(rows, "id long, source string, target string, relation string, copies string").repartition(4)
    f = ["source", "target", "relation"]
    groups = defaultdict(list)
    for i, *x, _ in rows:
        if all(v is not None for v in x):
            k = tuple("".join(c for c in fold(v) if c.isalnum()) for v in x)
            if all(k):
                groups[k].append(i)
    want = sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    assert sorted((x.first_id, x.copy_id) for x in records.copy_pairs(df, "id", f).collect()) == want
    got = {x.first_id: x.copies for x in records.collapsed(df, "id", f).collect()}
    assert got == {min(g): len(g) for g in groups.values()}
    assert records.copy_pairs(df.limit(0), "id", f).count() == 0


def test_lines(spark):
    lines = ['{"source":"a","target":"b","relation":"c","strength":1}', ' { "relation" : "c",\n"target":"\\u0062", "source":"a"} ', '{"source":"a","tar', None, "", "[1]", "null", '{"source":"a"}']
    got = {r.line_id: (r.source, r.target, r.relation) for r in records.parsed_lines(spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")).collect()}
    assert got == {0: ("a", "b", "c"), 1: ("a", "b", "c"), 7: ("a", None, None)}


def test_lines_collapse_before_they_are_parsed(spark):
    a, b = '{"source":"A b","target":"t","relation":"r"}', '{"target":"T!","relation":"R","source":"a-b"}'
    lines = [a] * 5 + [b] * 3 + ['{"source":"A b", "target":"t","relation":"r"}', '{"source":"x","target":"t","relation":"r"}', '{"cut', None]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string").repartition(3)
    f = ["source", "target", "relation"]
    got = {(x.first_id, x.copy_id) for x in records.copy_pairs(df, "line_id", f, ["line"], records.parsed_lines).collect()}
    assert got == {(0, i) for i in range(1, 9)}
    assert {(x.first_id, x.copies, x.spellings) for x in records.collapsed(df, "line_id", f, ["line"], records.parsed_lines).collect()} == {(0, 9, 2), (9, 1, 1)}


def test_pieces_round_trip(spark):
    r = random.Random(4)
    sent = lambda: "Söz " * r.randrange(3, 60) + r.choice(["son. ", "son; ", "m. 5 son.\r\n", "son\n"])
    texts = ["", "a", "x" * 1500, "x" * 1501, "y" * 9000, " " * 4000, "é" * 3000, "😀" * 2000, None] + ["".join(sent() for _ in range(n)) + ("Q" * r.choice([0, 3000])) for n in (5, 30, 100)]
    df = spark.createDataFrame([(str(i), t, 7) for i, t in enumerate(texts)], "id string, text string, piece int")
    by = defaultdict(list)
    for p in splitting.split_texts(df).collect():
        by[p.id].append(p)
    assert len(by) == len(texts) - 1
    for i, t in enumerate(texts):
        if t is None:
            continue
        ps = sorted(by[str(i)], key=lambda p: p.piece)
        assert "".join(p.piece_text[len(p.piece_text) - p.fresh :] for p in ps) == t
        assert [p.piece for p in ps] == list(range(1, ps[0].n_pieces + 1)) and (len(t) > 1500) == (len(ps) > 1)
        at = 0
        for p in ps:
            assert len(p.piece_text) <= 1500
            if p.piece > 1:
                assert p.piece_text[:120] == t[at - 120 : at]
            at += p.fresh
    with pytest.raises(ValueError):
        splitting.pattern(300, 120)


def test_sentences_are_not_cut(spark):
    t = " ".join(f"Heyət 5 saylı akt üzrə {'uzun ' * 8}qərarı m. {i} üzrə bərpa edir." for i in range(60))
    ps = splitting.split_texts(spark.createDataFrame([("a", t)], "id string, text string")).collect()
    assert all(p.piece_text.rstrip().endswith("edir.") for p in ps)


def test_containers(spark):
    r = random.Random(6)
    sizes = [r.choice([1, 5, 100, 700, 700, 700, 1500, 2048, 5000]) if r.random() < 0.6 else r.randrange(0, 2500) for _ in range(3000)]
    rows = list(enumerate(sizes)) + [(9999, None), (1, 3), (1, 3)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int").repartition(5)
    got = packing.pack(df).collect()
    fill, parts, whole = Counter(), defaultdict(list), Counter()
    for x in got:
        fill[x.container] += x.n_tokens
        parts[x.doc_id].append((x.part, x.n_tokens))
        whole[x.doc_id] += x.n_tokens
    want = Counter()
    for k, n in rows:
        want[k] += n or 0
    assert {k: v for k, v in whole.items()} == {k: v for k, v in want.items() if k != 9999}
    assert max(fill.values()) <= 2048
    for k, n in enumerate(sizes):
        if k != 1:
            assert len(parts[k]) == max(1, -(-n // 2048))
    bins: list[int] = []  # first fit, longest first
    for n in sorted((n for ps in parts.values() for _, n in ps if n), reverse=True):
        j = next((j for j, b in enumerate(bins) if b + n <= 2048), None)
        if j is None:
            bins.append(n)
        else:
            bins[j] += n
    assert len(fill) <= len(bins) + 1
    windows = Counter()
    for x in got:
        windows[x.container, x.tier, x.slot] += x.n_tokens
    assert all(n <= tier and slot < 2048 // tier for (_, tier, slot), n in windows.items())
    assert all(len({t for c, t, _ in windows if c == box}) == 1 for box in list(fill)[1:40])
    assert {t for _, t, _ in windows} >= {2048, 256}
    tokens, pieces, boxes = Counter(), Counter(), defaultdict(set)
    for x in got:
        tokens[x.step_group] += x.n_tokens
        pieces[x.step_group] += x.n_tokens > 0
        boxes[x.step_group].add(x.container)
    assert min(map(len, boxes.values())) >= 64 and max(tokens.values()) - min(tokens.values()) <= 0.02 * max(tokens.values()) + 2048
    most = max(Counter(x.container for x in got if x.n_tokens).values())
    # turns there and back differ by a container in all, and groups may have one container more
    assert max(pieces.values()) - min(pieces.values()) <= 2 * most
    assert packing.pack(df.limit(0)).count() == 0


def test_every_tier_packs_its_items():
    counts = {1500: 100, 548: 100, 900: 402, 124: 402, 400: 805, 112: 805, 200: 3003, 56: 3003}
    p = packing.plan(counts)
    tiers = Counter()
    for s, rs in p.ranges.items():
        for (first, m, _, k, _), end in zip(rs, [r[0] for r in rs[1:]] + [counts[s]]):
            tiers[s, k] += end - first
    assert tiers[900, 2] == 402 and tiers[400, 4] >= 800 and tiers[200, 8] >= 2996 and tiers[1500, 1] == 100
    assert sum(s * n for s, n in counts.items()) / (2048 * p.containers) > 0.98
    r = random.Random(1)
    many = packing.plan({s: r.randrange(1, 10**9) for s in range(1, 2049)})
    assert len(many.classes) < 50_000


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Uca Divan <|endoftext|>"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in packing.token_sizes(df).collect()}
    assert got == {1: packing.token_count("Uca Divan <|endoftext|>"), 2: 0} and got[1] > 8


def test_fm_index_against_scan():
    r = np.random.RandomState(1)
    for _ in range(20):
        runs = [r.randint(1, 5, r.randint(4, 40)) for _ in range(r.randint(1, 6))]
        runs += [runs[0]] * 3
        index = leakage.FMIndex.of(np.concatenate(runs), np.array([len(x) for x in runs]), 4)
        phrases = np.unique(r.randint(1, 5, (60, 3)), axis=0)
        low, high = index.find(phrases)
        for p, a, b in zip(phrases, low, high):
            want = sorted(int(index.run_start[k]) + i for k, run in enumerate(runs) for i in range(len(run) - 2) if (run[i : i + 3] == p).all())
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_words_in_arrays_are_those_of_the_expression():
    texts = ["İclas ICLAS ıclas iclas", "", "a_b—c\u00a0Ⅷ 12½ ŞƏRT É\u0301e", "x" * 5000 + " 😀 字体", "\ud800 lone", "  "]
    at, h, first, size = leakage.numbered_words(texts)
    got = [[texts[a][f : f + n] for a, f, n in zip(at, first, size) if a == i] for i in range(len(texts))]
    folded = [["".join(map(leakage._small, w)) for w in ws] for ws in got]
    assert folded == [leakage.words(t) for t in texts]
    by = defaultdict(set)
    for w, x in zip((w for ws in folded for w in ws), h):
        by[w].add(int(x))
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


def _leaks(docs, items, n):
    grams = defaultdict(set)
    for k, ts in items:
        for t in ts or []:
            w = leakage.words(t or "")
            for i in range(len(w) - n + 1):
                grams[tuple(w[i : i + n])].add(k)
    return {(d, k) for d, t in docs for i in range(len(leakage.words(t or "")) - n + 1) for k in grams.get(tuple(leakage.words(t)[i : i + n]), ())}


def test_leaks_against_brute_force(spark, monkeypatch):
    r = random.Random(8)
    vocab = [f"söz{i}" for i in range(30)] + ["İclas", "iclas", "ICLAS"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(f"i{k}", [text(20), text(14), None]) for k in range(8)] + [("short", [text(5)]), ("none", None), (None, [text(20)])]
    docs = [(d, text(r.randrange(60))) for d in range(80)]
    for d in range(80, 140):
        k, ts = r.choice(items[:8])
        w = ts[0].split()
        at = r.randrange(9)
        docs.append((d, f"{text(10)}, „{' — '.join(w[at : at + r.choice([11, 12, 13])]).upper()}“ {text(9)}"))
    docs += [(140, None), (141, ""), (142, docs[100][1]), (142, docs[100][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, spans string").repartition(3)
    it = spark.createDataFrame(items, "id string, texts array<string>")
    want = _leaks(docs, [x for x in items if x[0]], 12)
    for shard, block in ((2_000_000, 2_000_000), (30, 40)):
        monkeypatch.setattr(leakage, "BLOCK_WORDS", block)
        rows = leakage.leaks(df, it, shard=shard).collect()
        assert {(x.doc_id, x.item_id) for x in rows} == want and want
    by = dict(docs)
    for x in rows:
        for p in x.spans:
            assert len(leakage.words(by[x.doc_id][p.start : p.end])) >= 12 and by[x.doc_id][p.start].isalnum() and by[x.doc_id][p.end - 1].isalnum()
    # a second item set against the same index, without the texts
    index = leakage.build_index(df, shard=400).cache()
    late = spark.createDataFrame([("late", [docs[50][1] + " " + docs[120][1]])], "id string, texts array<string>")
    for its, w in ((it, want), (late, _leaks(docs, [("late", [docs[50][1] + " " + docs[120][1]])], 12))):
        assert {(x.doc_id, x.item_id) for x in leakage.search_index(index, its).collect()} == w and w
    bare = {(x.doc_id, x.item_id): x.spans for x in leakage.leaks(df, late, offsets=False).collect()}
    assert all(p.end - p.start >= 12 for v in bare.values() for p in v)
    assert leakage.leaks(df.limit(0), it).count() == 0 and leakage.leaks(df, it.limit(0)).count() == 0


CLEAN = {
    "az": "Müvəqqəti nümayəndəliyi səhiyyə fondunun təyinatını üç gün ərzində başqasına həvalə edir; şurası isə bunu qadağan edir. Ğövöcə bələdiyyəsi İcra Katibliyi ilə razılaşır.",
    "ru": "Нижняя комиссия лично объявляет охрану земельного участка согласно пункту 103. Решение действует до новой жалобы, палата ведёт список.",
    "tr": "Açık kurulu kira sözleşmesinin kullanımını belirler; şikâyetin bölünmesini yazılı olarak yasaklar. Gümrük deposunun değerini gözden geçirir.",
    "en": "The clerk’s office — “until notice” — confirms the status of the customs warehouse; Nohove’s council may suspend it.",
}


@pytest.mark.parametrize("lang,read", [(a, b) for a in CLEAN for b in ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "latin-1")])
def test_utf8_read_wrong_comes_back(lang, read):
    chars = encoding._chars(read)
    garbled = "".join(chars[b] for b in CLEAN[lang].encode())
    assert encoding.restore(garbled)[0] == CLEAN[lang]


@pytest.mark.parametrize("wrote,read", [("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp1252"), ("cp1251", "latin-1")])
def test_one_byte_pairs_come_back(wrote, read):
    garbled = "".join(encoding._chars(read)[b] for b in CLEAN["ru"].encode(wrote))
    assert encoding.restore(garbled)[0] == CLEAN["ru"]
    turkish = "".join(encoding._chars("latin-1")[b] for b in CLEAN["tr"].replace("â", "a").encode("iso8859-9"))
    assert encoding.restore(turkish)[0] == CLEAN["tr"].replace("â", "a")


def test_parts_and_twice_garbled_come_back():
    twice = CLEAN["az"]
    for _ in range(2):
        twice = "".join(encoding._chars("cp1252")[b] for b in twice.encode())
    assert encoding.restore(twice)[0] == CLEAN["az"]
    bad = "".join(encoding._chars("cp1252")[b] for b in "şikayətin bölünməsini".encode())
    assert encoding.restore(f"{CLEAN['tr']} {bad} {CLEAN['tr']}")[0] == f"{CLEAN['tr']} şikayətin bölünməsini {CLEAN['tr']}"


@pytest.mark.parametrize("text", [*CLEAN.values(), "ÂME ET ÉTÉ is a title", "Þelmarð qəsəbəsi üzrə", "«Ä»-карта", "“Ä-3” 5 m² ± 2 °C, © §", "DÉCISION À L’ÉTAT", "naïve São Paulo", "РЕШЕНИЕ СОВЕТА СССР»", "", "a", "£5 €6"])
def test_clean_texts_stay(text):
    assert encoding.restore(text) == (text, [])


@pytest.mark.parametrize("lang", sorted(SENTENCES))
def test_other_languages_stay_and_come_back(lang):
    texts = SENTENCES[lang]
    assert encoding.restore_all(texts) == (texts, [[] for _ in texts])
    for read in ("cp1252", "latin-1", "cp1251", "cp437"):
        text = " ".join(texts)
        bad = "".join(encoding._chars(read)[b] for b in text.encode())
        if bad != text:
            assert encoding.restore(bad)[0] == text


def test_capitals_come_back():
    text = "УКАЗ ПРЕЗИДЕНТА РОССИЙСКОЙ ФЕДЕРАЦИИ О НАЗНАЧЕНИИ МИНИСТРА"
    for wrote, read in (("cp1251", "koi8-r"), ("koi8-r", "cp1251")):
        bad = "".join(encoding._chars(read)[b] for b in text.encode(wrote))
        assert encoding.restore(bad)[0] == text


def test_many_texts_at_once_give_what_each_gives_alone():
    bad = ["".join(encoding._chars("cp1252")[b] for b in CLEAN["az"].encode()), "".join(encoding._chars("koi8-r")[b] for b in CLEAN["ru"].encode("cp1251"))]
    texts = [t for s in SENTENCES.values() for t in s]
    mixed = [x for i, t in enumerate(texts) for x in (t, None, "", bad[i % 2], t + " " + bad[0])]
    got = encoding.restore_all(mixed)
    assert got[0] == [t and encoding.restore(t)[0] for t in mixed] and got[1] == [encoding.restore(t)[1] if t else [] for t in mixed]


def test_repair_rows(spark):
    bad = "".join(encoding._chars("cp1252")[b] for b in CLEAN["az"].encode())
    rows = [(1, CLEAN["az"], 0), (2, bad, 0), (3, None, 0), (4, "", 0), (5, "itmi� mətn", 0), (2, bad, 0), (6, (CLEAN["ru"] + " ") * 300 + bad, 0)]
    got = sorted(((r.doc_id, r.text, r.garbled, r.lost) for r in encoding.repair(spark.createDataFrame(rows, "doc_id long, text string, lost int")).collect()), key=lambda x: x[0])
    assert [(g[0], g[2], g[3]) for g in got] == [(1, False, 0), (2, True, 0), (2, True, 0), (3, False, 0), (4, False, 0), (5, True, 1), (6, True, 0)]
    assert got[1][1] == CLEAN["az"] and got[3][1] is None and got[6][1].endswith(CLEAN["az"])
    assert encoding.garbled(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp1250", "cp1251", "cp1254"])
@pytest.mark.parametrize("text,part", [("Maddə 3.", "ə"), (CLEAN["az"] + " məktub " + CLEAN["az"], " məktub "), ("kitab için yazılan", "ç"), ("bir gün sonra", "ü"), ("ərzində göndərilir", "ö"), ("uzun ışıq", "ı"), ("the words go on — far from capitals", "—"), ("the clerk’s office", "’")])
def test_one_garbled_sequence_comes_back(read, text, part):
    at = text.index(part)
    bad = "".join(encoding._chars(read)[b] for b in part.encode())
    new, pairs = encoding.restore(text[:at] + bad + text[at + len(part) :])
    assert new == text and pairs


@pytest.mark.parametrize("text", ["«Р» и «С» стоят рядом", "CAFÉ™ is a mark", "Nestlé™, Pokémon® É", "ÉCOLE É™", "5 Ä° and Ã", "статАФК", "Alors…ô mon ami", "группа© 2020, 5 см² и 20°"])
def test_clean_signs_after_letters_stay(text):
    assert encoding.restore(text) == (text, [])
