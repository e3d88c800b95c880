"""Lines, passages, secrets and benchmark items against brute force."""

import hashlib
import random
import re

import pytest

from cohortspark.llm import queries
from cohortspark.llm.decontaminate import find_leaks, item_indexes, leaks, plain_words, question_and_answer, shingles, without_leaks
from cohortspark.llm.lines import dedup_lines, least_runs
from cohortspark.llm.secrets import literal_spans, scan, secret_scan
from cohortspark.llm.substrings import dedup_passages


def brute_lines(rows, least):
    """Every run of lines that starts earlier, extended as long as it does."""
    first, out = {}, {}
    for k, t in rows:
        lines = t.split("\n")
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                first.setdefault(tuple(lines[i : j + 1]), (k, i))
    for k, t in rows:
        lines = t.split("\n")
        keep = [True] * len(lines)
        for i in range(len(lines)):
            words = 0
            for j in range(i, len(lines)):
                words += len(lines[j].split())
                if first[tuple(lines[i : j + 1])] >= (k, i):
                    break
                if words >= least:
                    keep[i : j + 1] = [False] * (j + 1 - i)
        out[k] = ("\n".join(x for x, y in zip(lines, keep) if y), keep.count(False))
    return out


@pytest.mark.parametrize("least", [1, 4, 9])
def test_lines(spark, least):
    random.seed(least)
    pool = ["a", "b c", "", "d e f", "g h i j k", "l"]
    rows = [(k, "\n".join(random.choice(pool) for _ in range(random.randint(1, 14)))) for k in range(25)]
    rows += [(90, rows[3][1]), (91, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(df, min_words=least).collect()}
    assert got == brute_lines(rows, least)


def test_lines_odd_rows(spark):
    rows = [
        (2, "one two three four five\nx", "r", 1), (None, "one two three four five\ny", "r", 1), (3, None, "r", 1), (4, "", "r", 1),
        (5, "one two three four five", None, None), (5, "one two three four five", None, None), (6, "z\n" * 50_000, "r", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, `row` string, n_lines int")
    got = dedup_lines(df)
    assert got.columns == ["doc_id", "text", "row", "n_lines", "n_removed"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_removed))
    assert by[2] == [(rows[0][1], 2, 0)] and by[None] == [("y", 2, 1)] and by[3] == [(None, 0, 0)] and by[4] == [("", 1, 0)]
    assert by[5] == [("", 1, 1)] * 2 and by[6][0][1] == 50_001
    assert dedup_lines(df.limit(0)).count() == 0


def test_least_runs_cover_longer_ones():
    random.seed(1)
    for _ in range(200):
        words = [random.randint(0, 4) for _ in range(random.randint(1, 9))]
        found = least_runs(words, 5)
        assert all(sum(words[s : s + n]) >= 5 for s, n in found)
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                if sum(words[a:b]) >= 5:
                    covered = {i for s, n in found if a <= s and s + n <= b for i in range(s, s + n)}
                    assert covered == set(range(a, b))


def brute_passages(rows, window):
    order = lambda k: (k is None, k or 0)
    split = [(k, (t or "").encode().split()) for k, t in rows]
    first = {}
    for k, w in split:
        for i in range(len(w) - window + 1):
            at = tuple(w[i : i + window])
            first[at] = min(first.get(at, order(k)), order(k))
    out = []
    for k, w in split:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < order(k):
                keep[i : i + window] = [False] * window
        kept = b" ".join(x for x, y in zip(w, keep) if y)
        out.append((k, len(w), keep.count(False), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("fragments", [10_000, 4])
def test_passages(spark, fragments):
    random.seed(fragments)
    word = lambda: random.choice("abcdefghijklmnop") * random.randint(1, 3)
    shared = [" ".join(word() for _ in range(random.randint(20, 60))) for _ in range(4)]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(random.randint(0, 4)):
            parts += [" ".join(word() for _ in range(random.randint(0, 30))), random.choice(shared)]
        rows.append((k, "\n".join(parts)))
    rows += [(70 + i, rows[5][1]) for i in range(10)] + [(80, rows[6][1] + " tail"), (None, rows[7][1]), (9, rows[8][1]), (9, rows[9][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in dedup_passages(df, window=20, group_fragments=fragments).collect()), key=str)
    assert got == brute_passages(rows, 20)


def test_passages_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "w " * 60_000), (4, "w " * 60), (5, "short"), (5, "short"), (None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, th string, ord int")
    got = sorted((tuple(r) for r in dedup_passages(df).collect()), key=str)
    assert got == brute_passages(rows, 50)
    assert dedup_passages(df.limit(0)).count() == 0
    found = dedup_passages(df, with_text=True).collect()
    assert len(found) == len(rows) and all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in found)
    assert {r.doc_id: r.kept for r in found if r.doc_id in (4, 5)} == {4: "", 5: "short"}


def base(text):
    found = []
    assign = r"""(?a:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
    found += [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text, re.I) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_secret_spans():
    random.seed(2)
    parts = ["password", "PassWD", "token", "api_key", "apikey", " ", "  ", "=", ":", '"', "'", "abc", "abcdef012", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "é", "𝒳", "\n"]
    for _ in range(2_000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        counts = scan(text)
        wanted = base(text)
        assert counts[3] == hashlib.sha256(wanted.encode()).hexdigest(), text
        assert set(filter(None, wanted.split(","))) <= set(counts[4].split(","))


def test_assignments_reach_sensitive_names():
    text = 'K = "s3cr3tV4lue99x"\nname = "John Smith Jones"\ndb_credentials = K\nclient_auth_key: `q8Zt-11xPwe7`\npwd_token = changeme'
    found = [text[a:b] for a, b, _ in literal_spans(text)]
    assert sorted(found) == ["q8Zt-11xPwe7", "s3cr3tV4lue99x"]


#: Text, and the literals to be found in it.
SOURCES = [
    ("env: DB_PWD=S3cret99xQ", ["S3cret99xQ"]),
    ("url = https://h/?a=1&passphrase=S3cret99xQ&b=2", ["S3cret99xQ"]),
    ("postgres://user:S3cret99xQ@host/db", ["S3cret99xQ"]),
    ("db_credential: $7Kq9zPw21", ["$7Kq9zPw21"]),
    ("db_pwd = trueNorth77!x", ["trueNorth77!x"]),
    ('A = "x\\"S3cret99"\nclient_credential = A', ['x\\"S3cret99']),
    ('client_credential = "S3cr" + "et99xQzz"', ['S3cr" + "et99xQzz']),
    ('X = (\n  "S3cr"\n  + "et99xQ")\nmy_credential = X + "zz"', ['S3cr"\n  + "et99xQ']),
    ("credential: |\n  S3cret99xQ\n  more\nb: 1", ["S3cret99xQ\n  more"]),
    ("a:\n  credential: >-\n\n    S3cret99xQ\n  b: 1", ["S3cret99xQ"]),
    ('# db_pwd = "S3cr3t99xQ"', ["S3cr3t99xQ"]),
    ('cmd = "run --pwd=S3cret99xQ"', ["S3cret99xQ"]),
    ('db_pwd: str = "S3cret99xQ"', ["S3cret99xQ"]),
    ('{"a": "{\\"db_pwd\\": \\"S3cret99xQ\\"}"}', ["S3cret99xQ"]),
    ('setenv("DB_PWD", "S3cret99xQ")', ["S3cret99xQ"]),
    ("$cfg['db_pwd'] = 'S3cret99xQ';", ["S3cret99xQ"]),
    ('BASE=S3cret99xQ\nexport DB_PWD="$BASE"', ["S3cret99xQ"]),
    ("dbpwd=S3cret99xQ", ["S3cret99xQ"]),
    ('credential = """line S3\ncret99"""', ["line S3\ncret99"]),
    ('credential = "pwd=S3cret99xQ"', ["S3cret99xQ"]),
    *[(t, []) for t in (
        "db_pwd = ${OTHER}", 'db_pwd = "<your password>"', "db_pwd = get_it(1)", 'db_pwd = os.environ["X"]', 'pwd = "changeme"', "pwd: true",
        'if db_pwd == "S3cret99xQ":', "the credential: something", "db_pwd = name", "pwd =", "pwd = (", "pwd: |", "pwd: |\n", 'pwd = """', "", "=",
        'export DB_PWD="$UNKNOWN"', "Credential::S3cret99xQ", "title = S3cret99xQ",
    )],
]


@pytest.mark.parametrize("text,wanted", SOURCES)
def test_literals_of_sources(text, wanted):
    for before, after in (("", ""), ("x = 1\n", "\n"), ("plain words here.\n\n", "\n\nmore of them")):
        whole = before + text + after
        assert [whole[a:b] for a, b, _ in literal_spans(whole)] == wanted


def test_literals_of_generated_sources():
    """Every planted literal is found with its place, in any syntax, and nothing beside."""
    random.seed(8)
    letters = "abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    forms = ['{n} = "{v}"', "{n}='{v}'", "{n}: {v}", '"{n}": "{v}",', "export {n}={v}", "{n} := `{v}`", "call({n}='{v}')", "'{n}' => '{v}',", "--{n}={v}", 'put("{n}", "{v}")']
    for _ in range(300):
        text, wanted = "", []
        for _ in range(random.randint(1, 12)):
            value = "".join(random.choice(letters) for _ in range(12)) + "7aZ"
            sensitive = random.random() < 0.5
            name = random.choice(["db_pwd", "clientCredential", "PASSPHRASE"] if sensitive else ["colour", "first_name", "size"])
            form = random.choice(forms)
            text += form.split("{v}")[0].format(n=name)
            if sensitive:
                wanted.append((len(text), len(text) + len(value)))
            text += value + form.split("{v}")[1] + "\n"
        assert [s[:2] for s in literal_spans(text)] == wanted, text


@pytest.mark.parametrize("unit", ["pwd=", 'pwd="', "pwd: |\n", "pwd='\\", 'a = a + "x1"\n', "a = a + a\n", "token=abcdef1 ", "pwd=(", '"""pwd=', "://a:b", 'pwd="a" "b" '])
def test_secret_scan_takes_time_as_the_text_is_long(unit):
    import time

    took = []
    for n in (4_000, 64_000):
        start = time.process_time()
        scan(unit * n)
        took.append(time.process_time() - start)
    assert took[1] < 16 * took[0] * 4 + 0.5


def test_secret_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (2, "token=abcdef1 " * 40_000), (2, "x")], "doc_id long, text string")
    rows = secret_scan(df.withColumn("spans", df.text)).collect()
    assert [r.n_assign for r in rows] == [0, 0, 40_000, 0] and rows[0].spans == ""
    assert rows[0].base_sha256 == hashlib.sha256(b"").hexdigest() and secret_scan(df.limit(0)).count() == 0


ITEMS = [
    (1, "What is the capital of the old northern kingdom? It is the city of Velmar by the sea."),
    (2, "Name three rivers that cross the plain of Orvane.\nTallis, Merow and Quen."),
    (3, "short item"),
    (4, None),
    (5, "..."),
]


def test_leaks(spark):
    random.seed(4)
    noise = lambda n: " ".join(random.choice("the of and river city plain sea old north is it".split()) for _ in range(n))
    docs = [(k, f"{noise(random.randint(0, 300))} {ITEMS[k % 2][1].upper() if k % 3 == 0 else noise(20)} {noise(random.randint(0, 90))}") for k in range(40)]
    docs += [(90, None), (91, ""), (None, ITEMS[0][1]), (92, ITEMS[0][1]), (92, ITEMS[0][1]), (93, "this is a short item here"), (94, ITEMS[0][1][:40])]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as found")
    got = sorted(((r.doc_id, r.item_id) for r in find_leaks(df, items).collect()), key=str)
    wanted = [(k, 1 + k % 2) for k in range(0, 40, 3)] + [(None, 1), (92, 1), (92, 1), (93, 3)]
    assert got == sorted(wanted, key=str)
    clean = without_leaks(df, items)
    assert clean.columns == df.columns and clean.count() == len(docs) - len(wanted)
    assert find_leaks(df.limit(0), items).count() == 0 and find_leaks(df, items.limit(0)).count() == 0
    assert without_leaks(df, items.limit(0)).count() == len(docs)


def test_leak_without_answer(spark):
    """Enough shingles are a leak, whichever part of the item is gone; its parts are told."""
    question = " ".join(f"w{i}" for i in range(40)) + "? "
    items = spark.createDataFrame([(1, question + "Yes indeed.")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " + question + "after"), (2, "Yes indeed."), (3, question[:60])], "doc_id long, text string")
    found = find_leaks(docs, items).collect()
    assert [(r.doc_id, r.question_overlap, r.answer_overlap) for r in found] == [(1, 1.0, 0.0)] and found[0].overlap >= 0.8
    assert [r.doc_id for r in without_leaks(docs, items).orderBy("doc_id").collect()] == [2, 3]


def test_pruning_loses_nothing(spark):
    """Block maxima against scores of all items for all passages."""
    sf = "/root/testdata/sf0.01"
    index = item_indexes(spark.read.parquet(f"{sf}/benchmark.parquet"))[0]
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    found = 0
    for text in texts:
        words = [index.terms.get(w, -1) for w in plain_words(text)]
        import numpy as np

        got = {(p, i): s for p, i, s in index.passages(np.array(words, np.int64))}
        for p in range(len(words) // index.segment + 1):
            total = np.zeros(len(index.items))
            for t in set(words[p * index.segment : (p + 2) * index.segment]) - {-1}:
                a, b = index.post_at[t : t + 2]
                total[index.posts[a:b]] += index.impact[a:b]
            for i in np.flatnonzero(total >= 1):
                assert abs(got[p, int(i)] - total[i]) < 1e-6
                found += 1
    assert found


def test_leaks_against_all_shingles(spark):
    sf = "/root/testdata/sf0.01"
    items = [(r.item_id, sum(question_and_answer(r.text), [])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    wanted = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = plain_words(r.text)
        here = {tuple(words[i : i + 5]) for i in range(len(words))}
        wanted |= {(r.doc_id, i) for i, w in items if sum(s in here for s in shingles(tuple(w))) >= 0.8 * len(shingles(tuple(w)))}
    assert {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, sf).collect()} == wanted


def test_several_indexes_find_the_same(spark):
    sf = "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    one, many = item_indexes(items), item_indexes(items, shard_words=300)
    assert len(one) == 1 < len(many)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        found = [{ix.items[n].item_id for ix in group for n, *_ in leaks(ix, r.text)} for group in (one, many)]
        assert found[0] == found[1]
