"""Names, paths and locations: spellings made from the rules, and the few fixed cases that follow from them."""

from plumbline.functions import names, paths, tables
from pyspark.sql import functions as F

#: Families with sizes, and ways to write them.
SIZED = {"AES": ("128", "192", "256"), "Camellia": ("128", "256"), "RSA": ("2048", "4096"), "ML-KEM": ("512", "768"), "Falcon": ("512", "1024")}
CASES = (str, str.lower, str.upper)
SPELLINGS = [(f"{f}-{n}", f, n, case(f"{f}{sep}{n}{end}")) for f, sizes in SIZED.items() for n in sizes for sep in ("", "-", "_", " ", "/") for end in ("", "-CBC", " key") for case in CASES]
LETTERS = [m for m in tables.MARKERS if m.isalpha()]
#: A marker counts where a word begins, not inside of one; stopwords and empty names say nothing.
INSIDE = [f"qu{m.lower()}ish" for m in LETTERS]
AT_START = [(case(f"x {m}"), f) for m, f in tables.MARKERS.items() if m.isalpha() for case in (str.lower, str.upper)]

# Consequences of the rules that the survey pins.
PINNED_YES = [("AES-256-GCM", "256"), ("TLSv1.3", "1.3"), ("ECDSA-P256", "P-256"), ("RS256", "RSA")]
PINNED_NO = [("RS256", "RSA-2048")]


def test_families(spark):
    written = {*INSIDE, *tables.STOPWORDS, *(n for *_, n in SPELLINGS), *(n for n, _ in AT_START), "P-256", "", None}
    got = {r.name: r for r in names.name_features(spark.createDataFrame([(n,) for n in written], "name string")).collect()}
    assert [n for n in (*INSIDE, *tables.STOPWORDS, "P-256", "", None) if got[n].families] == []
    key = lambda f: f.upper().replace("-", "")
    assert [(n, got[n].families) for _, f, _, n in SPELLINGS if key(f) not in got[n].families] == []
    assert [(n, got[n].params) for _, _, size, n in SPELLINGS if got[n].params not in ([size], [])] == []
    assert [(n, f) for n, f in AT_START if f not in got[n].families] == []


def test_compatible(spark):
    yes = {(a, n) for a, f, _, n in SPELLINGS} | {(a, case(f)) for a, f, _, _ in SPELLINGS for case in CASES} | set(PINNED_YES)
    other_size = {(f"{f}-{n}", f"{f}-{m}") for f, sizes in SIZED.items() for n in sizes for m in sizes if n != m}
    other_family = {(f"{f}-{SIZED[f][0]}", g) for f in SIZED for g in SIZED if f != g}
    no = other_size | other_family | {(f"{f}-{n}", w) for f, sizes in SIZED.items() for n in sizes for w in ("", *INSIDE)} | set(PINNED_NO)
    pairs = spark.createDataFrame(sorted(yes | no), "algorithm string, name string")
    got = {(r.algorithm, r.name) for r in names.compatible_pairs(pairs, pairs).join(pairs, ["algorithm", "name"], "left_semi").collect()}
    assert (got - yes, yes - got) == (set(), set())


def test_paths(spark):
    files = spark.createDataFrame([("p", f) for f in ("src/main.rs", "src/envelope.rs", "internal/seal/seal.go", "cmd/beacon-relay/main.go", "keys/relay-key.pem", "a/x.go", "b/x.go", "b/c/y.go", "c/y.go")], "project string, path string")
    cases = {
        "src/main.rs": "src/main.rs", "/tmp/c-1/repo/internal/seal/seal.go": "internal/seal/seal.go", "x.go": None, "src/nonexistent.rs": None, "./src\\main.rs": "src/main.rs", "  keys/relay-key.pem ": "keys/relay-key.pem",
        "": None, "/tmp/b/c/y.go": "b/c/y.go", "c/y.go": "c/y.go", "q/c/y.go": None, "y.go": None, "/": None, "z/a/x.go": "a/x.go",
    }
    got = {r.file: r.resolved for r in paths.resolve_paths(spark.createDataFrame([("p", f) for f in cases], "project string, file string"), files).collect()}
    assert got == cases
    row = spark.range(1).select(*[paths.normalize_path(F.lit(x)) for x in ("./src/main.rs", "src\\main.rs", "  src/main.rs\t", "././a", "//a/./b")]).first()
    assert list(row) == ["src/main.rs", "src/main.rs", "src/main.rs", "a", "a/./b"]


def test_locations_and_projects(spark):
    rows = [("a.go", 10, "a.go", None, 2, False), ("a.go", 10, None, 10, 2, False), ("a.go", 10, "a.go", 12, 2, True), ("a.go", 10, "a.go", 8, 2, True), ("a.go", 10, "a.go", 13, 2, False), ("a.go", 10, "b.go", 10, 100, False)]
    df = spark.createDataFrame(rows, "f string, l int, g string, m int, t int, want boolean")
    assert df.filter(paths.location_matches(F.col("f"), F.col("l"), F.col("g"), F.col("m"), F.col("t")) != F.col("want")).count() == 0
    known = spark.createDataFrame([("box",), ("seal-box",), ("relay",)], "project string")
    cases = {"box": "box", "owner_seal-box": "seal-box", "owner/relay/": "relay", "mailbox": None, "o_box ": "box", "": None}
    got = {r.candidate: r.project for r in paths.match_project(spark.createDataFrame([(c,) for c in cases], "candidate string"), known).collect()}
    assert got == cases
    assert spark.range(1).select(paths.file_format(F.lit("a/b.tar.gz")), paths.file_format(F.lit("a.d/Makefile"))).first() == (".gz", "")
