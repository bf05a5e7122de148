"""The training-data operators against brute force, round trips and edge cases."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemolith.llm import history, leakage, near_duplicates, neighbours, packing, personal, sentences, splitting, topics
from mnemolith.llm import vectors as vectors_of
from mnemolith.llm import words as W

DAY = dt.datetime(2025, 1, 1)
# extra columns with names that the operators use themselves
MEM = "id string, content string, source_hash string, arrived_at timestamp_ntz, batch_id long, fp string, h string, n string, keys string, t string"


def memories(spark, rows):
    """rows of (id, content, source_hash, arrived_at, batch_id)"""
    return spark.createDataFrame([(*r, "x", None, "y", "z", "t") for r in rows], MEM)


def some_memories(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["naïve", "straße", "ＦＵＬＬ", "Ünï"]
    rows = []
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 13, 30, 80]))]
        for j in range(rng.choice([1, 1, 2, 4])):
            text = base[:]
            for _ in range(rng.choice([0, 1, 2, 5, 9])):
                k = rng.randrange(len(text))
                text[k] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                rng.shuffle(text)
            rows.append((f"m{i:02d}{j}", " ".join(text), rng.choice([None, "", "AB", "ab", f"h{i}"]), DAY + dt.timedelta(hours=len(rows)), rng.randrange(5)))
    rows += [(r[0], r[1], r[2], r[3] + dt.timedelta(days=9), 4) for r in rows[:7]]
    rows += [("nul", None, None, DAY, None), ("emp", "", "q", DAY, 0), ("emp2", "", "Q", DAY, 1), (None, "a b", "c", DAY, 1), ("noat", "x y z", None, None, None), ("long", "lorem ipsum " * 40_000, None, DAY, 2)]
    return rows


def firsts(rows):
    out = {}
    for r in sorted((r for r in rows if r[0]), key=lambda r: r[3] or dt.datetime.max):
        out.setdefault(r[0], r)
    return out


def brute_pairs(rows):
    one = {i: W.words(r[1]) for i, r in firsts(rows).items()}
    ids = sorted(i for i, w in one.items() if len(w) >= 12)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if W.similarity(one[a], one[b]) >= 0.8}


def brute_repeats(rows):
    pairs, one = brute_pairs(rows), firsts(rows)
    alike = {}
    for a, b in pairs:
        alike.setdefault(a, set()).add(b)
        alike.setdefault(b, set()).add(a)
    taken, seen, cases = set(), set(), set()
    for r in sorted(one.values(), key=lambda r: (-(2**62) if r[4] is None else r[4], r[0])):
        key = ((r[2] or "").lower(), tuple(W.words(r[1])))
        if alike.get(r[0], set()) & taken or key[0] and key in seen:
            cases.add(r[0])
        else:
            taken.add(r[0])
            seen.add(key)
    return cases


def test_words():
    assert W.words("Na­ïve  ​Straße_x2 ２ﬁ") == ["naive", "straße", "x2", "2fi"]
    assert W.words(None) == W.words("") == W.words("— …") == []
    assert W.words_or_han("第3版v2 和 ABC") == ["第", "3", "版", "v2", "和", "abc"]


@settings(max_examples=60, deadline=None)
# characters newer than the database of this Python are left out
@given(st.text(alphabet=st.characters(exclude_categories=("Cn", "Cs", "Co")), max_size=60))
def test_words_by_definition(text):
    import unicodedata

    import regex

    plain = "".join(c for c in unicodedata.normalize("NFKD", text.replace("­", "").replace("​", "")) if unicodedata.category(c) != "Mn").lower()
    assert W.words(text) == regex.findall(r"[\p{L}\p{N}]+", plain)


def test_near_duplicates(spark):
    rows = some_memories()
    got = [tuple(r) for r in near_duplicates.near_duplicate_pairs(memories(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)


def test_near_duplicate_groups_and_copies(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "EXPAND", 3)
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(f"c{i}", text, None, DAY, 1) for i in range(6)] + [("d", text.replace("w3 ", "zz "), None, DAY, 1), ("o", " ".join(f"v{i}" for i in range(30)), None, DAY, 1)]
    df = memories(spark, rows)
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(df).collect()}
    assert got == {("c0", f"c{i}") for i in range(1, 6)} | {("c0", "d")}
    groups = {r["id"]: (r["group_id"], r["copies"], r["links"]) for r in near_duplicates.near_duplicate_groups(df).collect()}
    assert groups["c4"] == ("c0", 6, 1) and groups["d"] == ("c0", 1, 1) and groups["o"] == ("o", 1, 0)


def test_pruning_keeps_what_can_reach_the_threshold():
    least = near_duplicates.least_equal_bits(64)
    assert 32 < least < 0.9 * 64 and near_duplicates.least_equal_bits(16) < 16 * 0.9


def test_history(spark):
    rows = some_memories(8)
    got = [r[0] for r in history.repeats_of_history(memories(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_repeats(rows)


def test_history_in_batches(spark, tmp_path):
    rows = [r for r in firsts(some_memories(5)).values() if r[4] is not None]
    index, got = history.History(spark, str(tmp_path / "index"), 3), set()
    for batch in sorted({r[4] for r in rows}):
        if batch == 3:
            # another session opens the folder, and an append that broke off is not seen
            index.close()
            index = history.History(spark, str(tmp_path / "index"), 3)
            history.touch(spark, f"{tmp_path}/index/_begun/99")
            index._append("ids", spark.createDataFrame([(r[0],) for r in rows], "id string"), 99)
        got |= {r[0] for r in index.add(memories(spark, [r for r in rows if r[4] == batch])).collect()}
    assert got == brute_repeats(rows)
    index.close()


def test_history_in_several_steps(spark):
    rows = some_memories(11)
    got = [r[0] for r in history.repeats_of_history(memories(spark, rows), rows_at_once=20).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_repeats(rows)


def test_history_knows_ids_that_arrive_again(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(20))
    index = history.History(spark, str(tmp_path / "again"), 2)
    assert index.add(memories(spark, [("m1", text, "h", DAY, 1), ("s1", "a b", "h", DAY, 1)])).count() == 0
    again = [("m1", text, "h", DAY, 2), ("s1", "a b", "h", DAY, 2), ("m2", text.replace("w3 ", "x "), None, DAY, 2), ("s2", "a b", "H", DAY, 2), ("s3", "a b", None, DAY, 2)]
    assert {r[0] for r in index.add(memories(spark, again)).collect()} == {"m2", "s2"}
    assert index.add(memories(spark, again)).count() == 0
    index.close()


def test_history_is_not_shuffled(spark, tmp_path):
    index = history.History(spark, str(tmp_path / "plan"), 4)
    index.add(memories(spark, [(f"m{i}", " ".join(f"w{i}x{k}" for k in range(20)), None, DAY, 1) for i in range(9)]))
    batch = history.sketches(memories(spark, [("n", " ".join(f"w3x{k}" for k in range(20)), None, DAY, 2)]))
    found = history.probe(index.old("segments"), history.segments(batch.where("fp IS NOT NULL"))).distinct()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan[plan.index("SortMergeJoin") :] and found.count() == 1
    index.close()


@pytest.mark.parametrize("n", [12, 20, 45, 100, 300])
def test_segments_meet_at_the_threshold(n):
    rng, met = np.random.default_rng(n), 0
    for _ in range(300):
        new = n // 9
        base = np.unique(rng.integers(0, 2**63, n + new + 50, dtype=np.uint64))[: n + new]
        a, b = base[:n], np.concatenate([base[new:n], base[n:]])
        sizes = np.array([len(a), len(b)])
        own, other = W.segments([a, b], W.length_class(sizes)), W.segments([a, b], W.other_class(sizes))
        ca, cb, ob = W.length_class(sizes)[0], W.length_class(sizes)[1], W.other_class(sizes)[1]
        same = own[1] if ca == cb else other[1] if ca == ob else None
        assert same is not None and len(same) == len(own[0])
        met += bool(((same == own[0]) & (same != 0)).any())
    assert met >= 298


@pytest.mark.parametrize("operator", [near_duplicates.near_duplicate_pairs, near_duplicates.near_duplicate_groups, history.repeats_of_history, splitting.split_sections])
def test_no_memories(spark, operator):
    assert operator(memories(spark, [("a", "b", None, DAY, 1)]).limit(0)).count() == 0


def test_sections():
    text = "pre\n# A\nx\n```\n# no\n```\n####### no\n#no\n## B\n~~~\n# open"
    assert [(n, h) for n, h, _ in splitting.sections(text)] == [(0, None), (1, "A"), (2, "B")]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab. \n,。é漢𝄞#"), max_size=900), st.integers(8, 40))
def test_pieces(text, limit):
    text = text.strip()
    found = splitting.pieces(text, limit, limit // 10)
    assert "".join(text[b:e] for _, b, e in found) == text
    for k, (start, body, end) in enumerate(found):
        assert splitting.tokens_of(text[start:end]) <= limit and end > body or not text
        assert splitting.tokens_of(text[start:body]) <= limit // 10
        assert k == 0 or found[k - 1][2] == body


def test_split_sections(spark):
    long = "# Head\n" + "One sentence of it. " * 100 + "\n# Next\nshort\n# Blob\n" + "x" * 5000
    df = memories(spark, [("a", long, None, DAY, 1), ("a", long, None, DAY + dt.timedelta(1), 1), ("n", None, None, DAY, 1), ("e", "", None, None, 1)])
    got = splitting.split_sections(df).collect()
    assert {(r["id"], r["section_no"], r["heading"]) for r in got} == {("a", 1, "Head"), ("a", 3, "Blob")}
    assert len({(r["section_no"], r["piece_no"]) for r in got}) == len(got) and max(r["n_tokens"] for r in got) <= 300


VEC = "memory_id string, vector array<float>, embedded_at timestamp_ntz, q string, n string, key string"


def vector_rows(seed=1, groups=14):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=64)
        centre /= np.linalg.norm(centre)
        for k in range(int(rng.integers(1, 25))):
            x = centre + rng.normal(size=64) * 0.03
            rows.append((f"g{g:02d}-{k:02d}", (x * rng.uniform(0.1, 9)).astype(np.float32).tolist(), DAY))
    bad = [("nul", None, DAY), ("emp", [], DAY), ("zero", [0.0] * 64, DAY), ("short", [1.0] * 63, DAY), ("nan", [float("nan")] * 64, DAY), ("inf", [float("inf")] * 64, DAY), ("hole", [None] + [1.0] * 63, DAY), (None, [1.0] * 64, DAY)]
    later = [(i, (-np.array(v)).tolist(), DAY + dt.timedelta(1)) for i, v, _ in rows[:5]] + [(i, v, None) for i, v, _ in rows[5:9]]
    return rows, bad + later


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "q", "n", "k") for r in rows], VEC)


def cosines(rows):
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T - 3 * np.eye(len(x))


def test_neighbours(spark):
    rows, more = vector_rows(groups=40)
    got = {tuple(r) for r in neighbours.similar_pairs(vectors(spark, rows + more)).collect()}
    c, true = cosines(rows), set()
    for i in range(len(rows)):
        for j in np.argsort(-c[i])[:5]:
            if c[i, j] >= 0.85:
                true.add(tuple(sorted((rows[i][0], rows[int(j)][0]))))
    assert len(got & true) >= 0.9 * len(true) and len(got - true) <= 0.1 * len(true)
    ranked = neighbours.neighbours(vectors(spark, rows + more)).groupBy("memory_id").agg(F.max("rank"), F.count(F.lit(1))).collect()
    assert all(r[1] == r[2] <= 5 for r in ranked)
    assert neighbours.similar_pairs(vectors(spark, more[:1])).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(vectors_of.hadamard(x.T), axis=0), np.linalg.norm(x, axis=1))
    r = vectors_of.rotated(np.eye(64), vectors_of.signs(1, 1)[0, 0])
    assert np.allclose(r @ r.T, np.eye(64), atol=1e-5)


def test_cells_follow_the_rows():
    for rows in (10, 1_000, 100_000, 10_000_000, 10_000_000_000):
        digits, last = vectors_of.shape(rows, 1000)
        assert rows / (128 ** (digits - 1) * 2 * last) <= 2000
        assert vectors_of.tables_for(rows, 1000, 0.85, 0.25)[0] <= 24


def test_topics(spark):
    rows, more = vector_rows(7)
    got = {tuple(r) for r in topics.topic_members(vectors(spark, rows + more)).select("memory_id", "cluster_id").collect()}
    c, label = cosines(rows), list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in [i, *np.flatnonzero(c[i] >= 0.85)]) for i in range(len(rows))]
    groups = {}
    for i, g in enumerate(label):
        groups.setdefault(g, []).append(rows[i][0])
    assert got == {(m, min(ms)) for ms in groups.values() if len(ms) >= 5 for m in ms}
    assert topics.topic_members(vectors(spark, more[:2])).count() == 0


DOC = "doc_id long, text string, lang string, window string, place string, part string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, None, "w", "p", "q") for i, t in enumerate(texts)], DOC)


def test_packing(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "漢字", "é"]) for _ in range(rng.choice([0, 1, 40, 200, 900, 5000]))) for _ in range(150)] + [None, "", "  "]
    count = packing.encoding(f"{packing.TOKENIZERS}/{packing.VOCABULARY}").encode_ordinary
    rows = packing.packed_texts(documents(spark, texts)).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["seq_id"], []).append((r["place"], r["n_tokens"]))
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        n = len(count(t or ""))
        assert sum(r["n_tokens"] for r in by_doc[i]) == n and len(by_doc[i]) == max(1, -(-n // 2048))
    for spans in by_seq.values():
        at = 0
        for place, n in sorted(spans):
            assert place == at
            at += n
        assert at <= 2048
    assert sum(r["n_tokens"] for r in rows) / len(by_seq) / 2048 > 0.9
    assert packing.packed_texts(documents(spark, ["x"]).limit(0)).count() == 0


def test_leaks(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    passages = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(6)]
    zh = "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(60))
    texts = [
        "noise " + " ".join(passages[0]) + " noise",
        " ".join(passages[1][10:23]).upper(),
        " ".join(passages[1][10:22]),
        " ".join(w if k % 14 else "edit" for k, w in enumerate(passages[2])),
        " ".join(w if k % 12 else "edit" for k, w in enumerate(passages[3])),
        zh[5:25], zh[5:24], None, "",
    ]
    items = spark.createDataFrame([(k, "en", " ".join(p), "q") for k, p in enumerate(passages)] + [(9, "zh", zh, None), (10, None, None, None), (None, "en", "x y", None)], "item_id long, lang string, passage string, question string")
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in leakage.leaks(documents(spark, texts), items).collect()}
    assert got == {(0, 0): True, (1, 1): True, (3, 2): True, (4, 3): False, (5, 9): True}
    assert leakage.leaks(documents(spark, texts), items.limit(0)).count() == leakage.leaks(documents(spark, texts).limit(0), items).count() == 0


@pytest.mark.parametrize("every", [4, 5, 8, 9])
def test_edited_copies_leak(every):
    rng = random.Random(every)
    vocabulary = [f"w{i}" for i in range(2000)]
    passages = [[rng.choice(vocabulary) for _ in range(90)] for _ in range(40)]
    items = leakage.Items([(k, "en", " ".join(p)) for k, p in enumerate(passages)])
    texts = []
    for p in passages:
        edited = [w if k % every else f"x{k}" for k, w in enumerate(p)]
        edited.insert(30, "inserted words here")
        del edited[60:62]
        texts.append("before it " + " ".join(edited) + " after it")
    texts += [" ".join(rng.choice(vocabulary) for _ in range(300)) for _ in range(40)]
    found = leakage._scan(leakage.pa.RecordBatch.from_pydict({"doc_id": list(range(80)), "text": texts}), items).to_pylist()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(k, k) for k in range(40)}


@pytest.mark.parametrize("text, n", [
    ("He got a new rev. Then it broke.", 2),
    ("Rev. Green spoke. All left.", 2),
    ("Բարև ձեզ։ Ինչպես եք։", 2),
    ("ជំរាបសួរ។ អរគុណ។", 2),
    ("ሰላም ነው። ደህና ነኝ።", 2),
    ("“" + "One. Two! " * 400 + "” That was long.", 2),
    ("Le rapport est prêt pour la réunion, cf. p. 12. Ensuite on part.", 2),
    ("La nota está en el archivo, págs. 3 y 4. Luego se cierra.", 2),
    ("Das ist der Plan und er wird bzw. wurde geprüft. Es geht.", 2),
])
def test_sentences_of_other_scripts_and_languages(text, n):
    assert len(pieces_of(text)) == n, pieces_of(text)


def pieces_of(text):
    starts = sentences.sentence_starts(text)
    return [text[a:b].strip() for a, b in zip(starts, [*starts[1:], len(text)])]


@pytest.mark.parametrize("text, n", [
    ("Dr. Smith paid approx. 3.5 kg, e.g. in the U.S. office. It failed! Did it? Yes...", 4),
    ("“It failed twice. We retried,” wrote the agent. Then it ran.", 2),
    ("See Fig. 3 and No. 9, tables, etc. The rest stays. foo-lite was rebuilt.", 3),
    ("Siehe Abb. 1 bzw. Nr. 2, z. B. am 3. März um 16.30 Uhr. Danach usw. Es geht.", 3),
    ("M. Petit a vu p. ex. la p. 4. « Échec. On attend », écrit-il. Attention : oui ! Fin.", 4),
    ("¿Por qué paró? ¡Atención: sí! El Sr. Gil midió p. ej. 3,5 s. «Falló. Esperamos», escribió.", 4),
    ("他写道:“失败了。再等等。”然后提高了。“完成！”好的……下一步？对", 5),
    ("「失敗した。待とう。」と書いた。完了！次は?はい。", 4),
    ("डॉ. राम ने कहा। क्या हुआ? “रुका। हम रुके,” ऐसा लिखा।", 3),
    ("ระบบนำเข้าใช้เวลา ทำไมจึงนับ? เสร็จแล้ว", 3),
    ("# Title\nA line\nthat goes on. Next.\n\n- item one. still\n- item two\n1. three\n\n```\nNo. Code.\n```\nEnd", 7),
])
def test_sentences(text, n):
    assert len(pieces_of(text)) == n, pieces_of(text)


def test_sentence_units(spark):
    texts = ["A. B c? D!", None, "", "   ", "```\nx. Y.\n```", "— … —", "word " * 50_000]
    got = sentences.sentence_units(documents(spark, texts)).collect()
    assert {r["doc_id"] for r in got} == {0, 6} and all(r["sentence"] for r in got)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=200))
def test_sentence_starts_are_in_order(text):
    starts = sentences.sentence_starts(text)
    assert starts == sorted(set(starts)) and all(not text[s].isspace() for s in starts)


LEXICON = tuple(sorted([(g, "given") for g in "Anna Bruno Clara Diego Mark May Rose".split()] + [(f, "family") for f in "Kelmark Tormark Velmark Bordahl Lindahl Rosdahl".split()]))


def found(text):
    lexicon = personal.Lexicon(list(LEXICON))
    return [(text[s:e], k) for s, e, k in personal.decode(text, lexicon, personal._fitted(LEXICON))]


@pytest.mark.parametrize("text, expected", [
    ("Mail <a.b+c@mail.example.org>, please.", [("a.b+c@mail.example.org", "email")]),
    ("Call +1 (362) 555-0147 after lunch.", [("+1 (362) 555-0147", "phone")]),
    ("The form shows ID 926-44-4189 for the file.", [("926-44-4189", "national_id")]),
    ("Ship it to 12 Quince Street, 08443 Quillhaven.", [("12 Quince Street, 08443 Quillhaven", "address")]),
    ("The talk with Dr. Anna Kelmark was moved.", [("Anna Kelmark", "name")]),
    ("Ask Bordahl, Clara about it.", [("Bordahl, Clara", "name")]),
    ("Mark the note. The Rose theme uses 12 icons. Version 10.12.4.2 replaced 9.55.01.", []),
    ("deploy@buildbox in /srv, ticket MX-2838, build 2025-03-14.", []),
    ("", []),
])
def test_personal(text, expected):
    assert found(text) == expected


# carriers that no phrase of the training shares
HELD_OUT = [
    ("Reach out to Bruno Kelmark regarding the lease.", {("Bruno Kelmark", "name")}),
    ("Our landlord is Mr. Tormark.", {("Tormark", "name")}),
    ("Clara just left the building.", {("Clara", "name")}),
    ("Kündigung von Anna Lindahl erhalten.", {("Anna Lindahl", "name")}),
    ("La cita con Diego Rosdahl fue larga.", {("Diego Rosdahl", "name")}),
    ("Un colis pour Mme Velmark.", {("Velmark", "name")}),
    ("My cell is +49 171 2345678, ring anytime.", {("+49 171 2345678", "phone")}),
    ("For emergencies: (212) 555-0188", {("(212) 555-0188", "phone")}),
    ("Rappelez-moi au 01 42 68 53 00.", {("01 42 68 53 00", "phone")}),
    ("Driver gave social security 123-45-6789 at the desk.", {("123-45-6789", "national_id")}),
    ("Document X1234567L expired.", {("X1234567L", "national_id")}),
    ("They live on 14 Maple Avenue near the park.", {("14 Maple Avenue", "address")}),
    ("Paket bitte in den Birkenweg 12, 50667 Köln bringen.", {("Birkenweg 12, 50667 Köln", "address")}),
    ("Rendez-vous au 8 rue des Lilas, 69003 Lyon.", {("8 rue des Lilas, 69003 Lyon", "address")}),
    ("La oficina está en Calle del Sol, 44.", {("Calle del Sol, 44", "address")}),
    ("The parcel went to Via Roma 12, 00184 Roma.", {("Via Roma 12, 00184 Roma", "address")}),
    ("Questions? support.team@mail.example.com", {("support.team@mail.example.com", "email")}),
    ("Please ask Zoltan Horvath about it.", {("Zoltan Horvath", "name")}),
    ("The committee elected Marisol Quintana yesterday.", {("Marisol Quintana", "name")}),
    ("Yesterday I met Tomasz Wieczorek.", {("Tomasz Wieczorek", "name")}),
    ("The Blue Mountain Trail opens in May.", set()),
    ("Mark your calendar for the launch.", set()),
    ("Invoice 4400123 was paid on 2024-02-29.", set()),
    ("Python 3.12.1 runs on 10.20.30.40.", set()),
]


def test_personal_held_out():
    """At the time of writing 18 of 20 cases are found, and one of 19 found is none."""
    right = wrong = missed = 0
    for text, gold in HELD_OUT:
        got = set(found(text))
        right, wrong, missed = right + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert right / (right + wrong) >= 0.85 and right / (right + missed) >= 0.85, (right, wrong, missed)


def test_personal_generated():
    lexicon, weights = personal.Lexicon(list(LEXICON)), personal._fitted(LEXICON)
    rng, right, wrong, missed = random.Random(77), 0, 0, 0
    for _ in range(400):
        text, gold = personal._filled(rng, lexicon, ["Anna", "Bruno", "Clara"], ["Kelmark", "Bordahl"])
        got = set(personal.decode(text, lexicon, weights))
        right, wrong, missed = right + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.85, (right, wrong, missed)


def test_personal_tables(spark):
    df = memories(spark, [("a", "cc anna@example.com now", None, DAY, 1), ("a", "cc anna@example.com now", None, DAY, 2), ("n", None, None, None, None), ("e", "", None, DAY, 1), (None, "x", None, DAY, 1), ("l", "word " * 100_000, None, DAY, 1)])
    records = spark.createDataFrame([("s", "call 030 23125 737 or not", "k")], "source_id string, content string, kind string")
    lexicon = spark.createDataFrame(LEXICON, "name_part string, part_kind string")
    got = {tuple(r) for r in personal.personal_spans(df, records, lexicon).collect()}
    assert got == {("memories", "a", "email", 3, 19), ("source_records", "s", "phone", 5, 18)}
    texts = {r["content"] for r in personal.redacted_records(df, records, lexicon).collect()}
    assert {"cc [EMAIL] now", "call [PHONE] or not", "x"} <= texts
    assert personal.personal_spans(df.limit(0), records.limit(0), lexicon.limit(0)).count() == 0
