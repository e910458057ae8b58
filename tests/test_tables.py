import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leakframe import fixed_values as fv
from leakframe import schemas
from leakframe.operators import detect, feedback, jobs, redact, report, secrets, verify
from leakframe.operators.rules import Rule, ScanConfig


def found(spark, rows):
    """rows: (value, type, severity, path, line, commit, seq)"""
    df = spark.createDataFrame(rows, "value string, secret_type string, severity string, path string, line_number int, commit_hash string, commit_seq int")
    return df.select(
        "*", F.sha2("value", 256).alias("value_hash"), F.lit(1).alias("rule_ord"), F.col("line_number").alias("match_start"),
        F.timestamp_seconds(F.col("commit_seq") * 86400).alias("commit_ts"), F.lit(None).cast("string").alias("context"),
        F.col("value").alias("exposed_value"), F.lit(False).alias("false_positive"), F.lit("rule").alias("detector"),
        F.lit("n").alias("suggested_variable"), F.lit(None).cast("string").alias("variable_name"), F.lit("d").alias("description"),
    )


def many(spark, n=400):
    rng = random.Random(2)
    return found(spark, [
        (rng.choice(["hot", "hot", "a", "b", f"v{i}"]), rng.choice(["api_key", "password"]), rng.choice(fv.SEVERITIES[:4]),
         f"f{rng.randint(0, 20)}", i, f"c{rng.randint(0, 9)}", rng.randint(0, 9)) for i in range(n)
    ])


def test_fold_does_not_depend_on_partitions(spark):
    df = many(spark)
    a, b = (sorted(map(str, secrets.fold(d).collect())) for d in (df.repartition(1), df.repartition(7, "line_number")))
    assert a == b
    rows = [r.asDict() for r in df.collect()]
    hot = [r for r in rows if r["value"] == "hot"]
    got = secrets.fold(df).where("value = 'hot'").first()
    first = min(hot, key=lambda r: (r["commit_seq"], r["path"], r["rule_ord"], r["match_start"]))
    assert (got.secret_type, got.severity, got.path) == (first["secret_type"], first["severity"], first["path"])
    assert got.n_files == len({r["path"] for r in hot}) and got.n_commits == len({r["commit_hash"] for r in hot})


def test_first_places_are_the_first(spark):
    df = many(spark)
    got = {r.value_hash: r.first_paths for r in secrets.first_places(df, "path", 3).collect()}
    best = {}
    for r in df.collect():
        o = (r.commit_seq, r.path, r.rule_ord, r.match_start)
        per = best.setdefault(r.value_hash, {})
        per[r.path] = min(per.get(r.path, o), o)
    assert got == {h: [p for p, _ in sorted(per.items(), key=lambda x: x[1])][:3] for h, per in best.items()}


def test_partials_against_brute_force(spark):
    rng = random.Random(6)
    fulls = ["Server=" + "".join(rng.choice("abcd") for _ in range(12)) + ";Password=" + "".join(rng.choice("abcd") for _ in range(10)) for _ in range(30)]
    parts = [rng.choice(fulls)[s : s + rng.randint(1, 14)] for s in (rng.randint(0, 20) for _ in range(60))]
    parts += ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 12))) for _ in range(60)] + fulls[:2] + ["Server=é😀"]
    rows = [(f, "connection_string_full") for f in fulls] + [(p, "database_password") for p in parts] + [("Server=", "api_key")]
    df = spark.createDataFrame(rows, "value string, secret_type string")
    want = [r for r in rows if r[1] != "database_password" or not any(r[0] in f and r[0] != f for f in fulls) and r[0] != ""]
    got = [(r.value, r.secret_type) for r in secrets.drop_covered_partials(df).collect()]
    assert sorted(got) == sorted(want)


def test_compare_adds_up(spark):
    df = many(spark)
    base, cur = df.where("commit_seq < 6"), df.where("commit_seq > 3")
    row = secrets.compare_summary(base, cur).first()
    b, c = ({r.value for r in x.collect()} for x in (base, cur))
    assert (row.unique_cleaned, row.unique_remaining, row.new_findings) == (len(b - c), len(b & c), len(c - b))
    assert row.unique_cleaned + row.unique_remaining == len(b)
    assert secrets.compare_summary(base.limit(0), cur.limit(0)).first().cleanup_percentage == 0


def test_severity_counts_fill_zeros(spark):
    df = found(spark, [("a", "t", "critical", "f", 1, "c", 1), ("b", "t", "high", "f", 1, "c", 1), ("c", "t", "high", "f", 1, "c", 1)])
    assert {r.severity: r.n for r in report.severity_counts(df).collect()} == {"critical": 1, "high": 2, "medium": 0, "low": 0}
    assert report.result_counts(df).first().total == 3
    assert report.result_counts(df.withColumn("false_positive", F.col("value") == "a")).first().total == 2


def test_large_objects_boundary(spark):
    limit = fv.LARGE_OBJECT_BYTES
    rows = [("r", "s1", "a", "blob", limit), ("r", "s2", "a", "blob", limit + 1), ("r", "s3", "a", "blob", limit + 5), ("r", "s4", "b", "tree", limit * 2), ("r", "s5", None, "blob", limit * 3)]
    got = {r.path: r.size_bytes for r in report.large_objects(spark.createDataFrame(rows, schemas.OBJECTS)).collect()}
    assert got == {"a": limit + 5, "s5": limit * 3}


def test_redact_then_rescan_finds_nothing(spark):
    rule = [Rule("k", "k", r"key=(\S+)", "api_key", "high", ord=1)]
    quiet = ScanConfig(entropy_enabled=False)
    body = "key=Zx81-qQ7m-Longer key=Zx81-qQ7m\nplain text\nkey=Zx81-qQ7m-Longer"
    files = spark.createDataFrame([("r", "a.txt", body), ("r", "b.txt", "nothing")], "repo string, path string, content string")
    hits = detect.findings(detect.scan(files, rule, quiet))
    purge = redact.select_purge(hits).withColumn("replacement", F.lit(fv.REMOVED))
    clean = redact.redact_everywhere(files, purge)
    texts = {r.path: r.content for r in clean.collect()}
    assert texts["b.txt"] == "nothing" and texts["a.txt"].count(fv.REMOVED) == 3 and "Longer" not in texts["a.txt"]
    left = secrets.verify_clean(detect.findings(detect.scan(clean, rule, quiet)), purge)
    assert left.where("was_purged").count() == 0


def test_a_bare_value_in_another_file_is_redacted_and_found(spark):
    rule = [Rule("k", "k", r'token = "(\S+)"', "auth_token", "high", ord=1)]
    files = spark.createDataFrame(
        [("r", "a.py", 'token = "Zk93hfQ0pLm2"'), ("r", "b.txt", "bare Zk93hfQ0pLm2 here"), ("s", "c.txt", None)], "repo string, path string, content string"
    )
    hits = detect.findings(detect.scan(files, rule, ScanConfig(entropy_enabled=False)))
    purge = redact.select_purge(hits)
    assert sorted((r.path, r.value) for r in redact.literal_hits(files, purge, ["repo", "path"]).collect()) == [("a.py", "Zk93hfQ0pLm2"), ("b.txt", "Zk93hfQ0pLm2")]
    clean = redact.redact_everywhere(files, purge)
    assert {r.path: r.content for r in clean.collect()} == {"a.py": 'token = ""', "b.txt": "bare  here", "c.txt": None}
    assert redact.literal_hits(clean, purge, ["repo", "path"]).count() == 0
    plan = clean._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("limit", [9, 1 << 20])
def test_redaction_in_pieces_equals_a_loop(spark, limit):
    rng = random.Random(limit)
    values = list({"".join(rng.choice("abAB") for _ in range(rng.randint(1, 6))) for _ in range(40)})
    texts = ["".join(rng.choice("abAB ") for _ in range(rng.randint(0, 60))) for _ in range(50)]
    purge = spark.createDataFrame([(v, "a" if i % 3 else "") for i, v in enumerate(values)], "value string, replacement string")
    files = spark.createDataFrame(list(enumerate(texts)), "path int, content string")
    order = sorted(purge.collect(), key=lambda r: (-len(r.value), r.value))
    want = []
    for text in texts:
        for r in order:
            text = text.replace(r.value, r.replacement)
        want.append(text)
    got = {r.path: r.content for r in redact.redact_everywhere(files, purge, limit=limit).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_long_values_and_all_characters_are_found(spark, limit):
    """Values on piece borders, longer than what is compared first, with characters outside the BMP,
    with a shared beginning, in empty, null and repeated texts; broadcast and Bloom filter agree."""
    shared = "postgres://user:" + "x" * redact.HEAD
    values = [shared + "one", shared + "two", "postgres", "\U0001f511key\U0001f511\U0001f511!\n.*", "ab", "(a|b)\\E$1", "never there"]
    pad = "\U0001f600p" * (redact.PIECE // 2 - 3)
    texts = ["", None, pad + values[3] + pad + values[5], shared + "on", values[1] * 3, "cabc", "cabc", pad + "postgre" + pad + "postgres"]
    files = spark.createDataFrame(list(enumerate(texts)), "path int, content string")
    purge = spark.createDataFrame([(v,) for v in values + ["", None]], "value string")
    got = sorted((r.path, r.value) for r in redact.literal_hits(files, purge, ["path"], limit=limit).collect())
    assert got == sorted((i, v) for i, t in enumerate(texts) for v in values if t and v in t)
    want = []
    for text in texts:
        for v in sorted(values, key=lambda v: (-len(v), v)):
            text = text and text.replace(v, "")
        want.append(text)
    clean = {r.path: r.content for r in redact.redact_everywhere(files, purge, limit=limit).collect()}
    assert [clean[i] for i in range(len(texts))] == want
    assert redact.redact_everywhere(files, purge.limit(0)).count() == len(texts)
    assert redact.redact_everywhere(files.limit(0), purge).count() == 0


def test_a_hundred_thousand_values_stay_off_the_driver(spark):
    values = spark.range(100_000).select(F.concat(F.lit("https://h/"), F.sha2(F.col("id").cast("string"), 256)).alias("value"))
    files = spark.range(2_000).select(
        F.col("id").alias("path"),
        F.concat(F.lit("see https://h/"), F.sha2((F.col("id") * 75).cast("string"), 256), F.lit(" https://h/none end")).alias("content"),
    )
    texts = files.select(F.sha2("content", 256).alias("key"), F.col("content").alias("body"))
    hits = redact.literal_hits(files, values, ["path"])
    assert hits.count() == files.where("path * 75 < 100000").count() == 1_334
    assert hits.select("value").distinct().join(values, "value").count() == 1_334
    found = redact.occurrences(texts, redact._listed(values), limit=0)
    assert found.count() == 1_334
    for df in (hits, found):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InArrow" not in plan
        assert not any("Exchange" in line and ("body" in line or "content" in line) for line in plan.splitlines())


def test_repositories_keep_their_own_secrets(spark):
    rows = [("r1", "a.py", "c1", 1, "v"), ("r2", "z.py", "c2", 2, "v"), ("r2", "z.py", "c3", 3, "v")]
    df = spark.createDataFrame(rows, "repo string, path string, commit_hash string, commit_seq int, value string").select(
        "*", F.sha2("value", 256).alias("value_hash"), F.lit(1).alias("rule_ord"), F.lit(0).alias("match_start"), F.lit("api_key").alias("secret_type"),
        F.lit("high").alias("severity"), F.lit(1).alias("line_number"),
    )
    per = secrets.per_file(secrets.fold(df), secrets.places(df, "path"))
    assert sorted((r.repo, r.path) for r in per.collect()) == [("r1", "a.py"), ("r2", "z.py")]
    assert sorted((r.repo, r.path, r.n) for r in report.file_counts(df).collect()) == [("r1", "a.py", 1), ("r2", "z.py", 2)]


def test_findings_of_several_commits_are_verified_once_each(spark):
    rule = [Rule("k", "k", r"key=(\S+)", "api_key", "high", ord=1)]
    rows = [("r1", "c1", "a", "key=Zx81-qQ7m-Lo"), ("r1", "c2", "a", "key=Zx81-qQ7m-Lo"), ("r2", "c1", "a", "key=Zx81-qQ7m-Lo")]
    files = spark.createDataFrame(rows, "repo string, commit_hash string, path string, content string")
    found = detect.findings(detect.scan(files, rule, ScanConfig(entropy_enabled=False)))
    assert found.select("finding_id").distinct().count() == 3
    assert report.with_verification(found, verify.verify(found).unionByName(verify.verify(found))).count() == 3


def test_purge_selection(spark):
    rows = [("short", "api_key"), ("password", "api_key"), ("long-enough-1", "api_key"), ("two\nlines here", "api_key"), ("long-enough-1", "jwt")]
    got = redact.select_purge(spark.createDataFrame(rows, "value string, secret_type string")).collect()
    assert [(r.value, r.replacement) for r in got] == [("long-enough-1", "")]
    line = redact.purge_line(F.col("v"), F.lit("X"))
    df = spark.createDataFrame([("a.b",), ("a==>b",)], "v string")
    assert [r.x for r in df.select(line.alias("x")).collect()] == ["a.b==>X", r"regex:a==>b==>X"]


def test_rewrites_per_language(spark):
    cases = {
        "a.sh": ("export KEY='v1'", 'export KEY="${KEY}"'),
        "a.py": ('key = "v1"  # c', "key = os.environ.get('KEY')  # c"),
        "a.ts": ("const k = 'v1';", "const k = process.env.KEY;"),
        "a.java": ('String k = "v1";', 'String k = System.getenv("KEY");'),
        "a.go": ('k := "v1"', 'k := os.Getenv("KEY")'),
        "a.rb": ("k = 'v1'", "k = ENV['KEY']"),
        "a.php": ("$k = 'v1';", "$k = getenv('KEY');"),
        "a.yml": ('key: "v1"', 'key: "${KEY}"'),
        "Dockerfile": ("ENV KEY=v1", 'ENV KEY="${KEY}"'),
        "a.txt": ("KEY: v1", 'KEY: "${KEY}"'),
    }
    files = spark.createDataFrame([(p, "first\n" + b + "\nlast") for p, (b, _) in cases.items()], "path string, content string")
    asks = spark.createDataFrame([(p, n, "KEY") for p in cases for n in (2, 9)], "path string, line_number int, var_name string")
    plan = redact.plan_rewrites(files, asks)
    got = {r.path: r for r in plan.where("line_number = 2").collect()}
    for p, (_, after) in cases.items():
        assert got[p].new_line == after and got[p].changed, p
    assert got["a.py"].import_needed == "import os"
    errors = plan.where("not success").collect()
    assert len(errors) == len(cases) and errors[0].error == "Line 9 out of range (file has 3 lines)"
    texts = {r.path: r.content for r in redact.apply_rewrites(files, plan).collect()}
    assert texts["a.rb"] == "first\nk = ENV['KEY']\nlast"
    summary = redact.rewrite_summary(plan).first()
    assert (summary.files_modified, summary.replacements_made, summary.errors) == (10, 10, 10)


def test_format_checks(spark):
    rows = [
        ("aws_access_key", "AKIA" + "A" * 16, "unverified"), ("slack_webhook", "https://evil.example/T1", "verified_inactive"),
        ("sentry_dsn", "https://abc1@o1.ingest.sentry.io/42", "unverified"), ("sentry_dsn", "bad", "verified_inactive"),
        ("mongodb_connection", "mongodb+srv://u:p@host/db", "unverified"), ("no_such_type", "v", "unverified"), ("vault_token", "v", "unverified"),
        ("pypi", "nope", "verified_inactive"),
    ]
    df = spark.createDataFrame(rows, "k string, v string, want string")
    for r in df.select("*", verify.format_status(F.col("k"), F.col("v")).alias("s")).collect():
        assert r.s.status == r.want, r
    assert verify.format_status(F.lit(None).cast("string"), F.lit("v")) is not None


def test_probe_beats_format(spark):
    f = spark.createDataFrame([("1", "github_token", "x"), ("2", "aws_access_key", "x"), ("3", "stripe", "x")], "finding_id string, secret_type string, value string")
    p = spark.createDataFrame([("1", 403, "API Rate Limit hit"), ("2", 200, ""), ("3", 200, "")], "finding_id string, http_status int, body string")
    got = {r.finding_id: (r.status, r.outcome) for r in verify.verify(f, p).collect()}
    assert got == {"1": ("rate_limited", "unknown"), "2": ("unverified", "unknown"), "3": ("verified_active", "active")}


def items(spark, spec):
    rows = [(shape, i < tp) for shape, tp, n in spec for i in range(n)]
    return spark.createDataFrame(rows, "value_pattern string, is_true_positive boolean")


def test_known_false_positive_boundaries(spark):
    df = items(spark, [("nine", 0, 9), ("exact", 2, 10), ("over", 1, 10)])
    assert [(r.pattern, r.confidence) for r in feedback.known_false_positives(df).collect()] == [("over", 0.9)]


def test_requests_last_hour_against_brute_force(spark):
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    times = [("c" if rng.random() < 0.7 else "d", start + dt.timedelta(seconds=rng.choice([rng.randint(0, 9000), 3600, 0, 7200]))) for _ in range(250)]
    df = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(times)], "i int, client_id string, ts timestamp")
    for r in feedback.requests_last_hour(df).collect():
        assert r.requests_last_hour == sum(c == r.client_id and r.ts - dt.timedelta(hours=1) <= t <= r.ts for c, t in times)


def test_transitions_and_selection(spark):
    h = spark.createDataFrame([("j", i, s) for i, s in enumerate(["pending", "cloning", "scanning", "cleaning", "failed", "pending"])], "job_id string, seq int, status string")
    got = [r.valid for r in jobs.check_transitions(h).orderBy("seq").collect()]
    assert got == [True, True, True, False, True, False]
    s = spark.createDataFrame([("j", 1, True, False), ("j", 2, False, False), ("j", 3, False, False), ("k", 1, True, False)], "job_id string, id int, selected_for_cleaning boolean, is_false_positive boolean")
    act = spark.createDataFrame([("j", 2, "select"), ("j", 3, "select"), ("j", 3, "false_positive")], "job_id string, secret_id int, action string")
    rows = {(r.job_id, r.id): (r.selected_for_cleaning, r.is_false_positive) for r in jobs.apply_selection(s, act).collect()}
    assert rows == {("j", 1): (False, False), ("j", 2): (True, False), ("j", 3): (False, True), ("k", 1): (True, False)}


def test_outbox_routes(spark):
    now = dt.datetime(2024, 1, 10)
    rows = [("a", False, None, 4), ("b", False, None, 5), ("c", True, now - dt.timedelta(hours=71), 0), ("d", True, now - dt.timedelta(hours=73), 0)]
    df = spark.createDataFrame(rows, "id string, published boolean, published_at timestamp, retry_count int")
    got = {r.id: r.route for r in jobs.outbox_split(df, F.lit(now)).collect()}
    assert got == {"a": "publish", "b": "dead_letter", "c": "keep", "d": "purge"}


def test_classifier_learns_a_plain_rule(spark):
    rows = [(f"[alpha:{n}]" if n % 2 else f"[alnum:{n}]", n, "python", "api_key", n % 2 == 0) for n in range(4, 60)]
    df = spark.createDataFrame(rows, "value_pattern string, value_length int, file_type string, secret_type string, is_true_positive boolean")
    model = feedback.fp_classifier(df, trees=5)
    scored = model.transform(feedback.classifier_features(df))
    assert scored.where(F.col("prediction") == F.col("label")).count() > 50
    many = [(f"[alpha:{n}]", n, "python", f"kind{n}", n % 2 == 0) for n in range(400)]
    wide = feedback.fp_classifier(spark.createDataFrame(many, df.schema), trees=2)
    assert wide.transform(feedback.classifier_features(df)).count() == df.count()


def test_anchors_are_found_at_every_place_and_on_slice_borders(spark, monkeypatch):
    """The looked up places are those of a search for each anchor, of any size, over several slices."""
    import numpy as np

    from leakframe.operators import anchors

    monkeypatch.setattr(anchors, "SLICE", 24)
    rng = random.Random(5)
    text = bytes(rng.choice(b"abc") for _ in range(300)) + "é😀".encode() * 9
    known = sorted({text[i:i + n] for i, n in ((0, 8), (21, 8), (23, 3), (150, 5), (280, 8), (len(text) - 8, 8))} | {b"zz", b"zzzzzzzz"})
    marks = anchors.bitmap(spark.createDataFrame([(bytearray(k),) for k in known], "anchor binary"), anchors.ROW_BITS)
    data = np.frombuffer(text + bytes(anchors.ANCHOR), np.uint8)
    sizes = sorted({len(k) for k in known})
    got = {(size, at) for size, places in anchors._found(data, sizes, marks, anchors.ROW_BITS) for at in places.tolist() if at + size <= len(text)}
    want = {(len(k), at) for k in known for at in range(len(text)) if text.startswith(k, at)}
    assert want <= got and {g for g in got - want if text[g[1]:g[1] + g[0]] in known} == set()
    assert len(got) < len(want) + 20
