"""The evidence frames over the driver's tables: parts are plants, orders are components, line items are claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import score
from plumbline.sources.stored import cut

PLANTED = (
    "AES-256", "AES-256-GCM", "ECDHE-ECDSA-AES256-GCM-SHA384", "ECDSA-P256", "Ed25519", "Falcon-512", "Falcon-1024", "LMS", "ML-DSA", "ML-DSA-65", "ML-KEM", "ML-KEM-512", "ML-KEM-768", "PKCS#12", "PyNaCl",
    "RS256", "RSA-2048", "SHA-256", "SLH-DSA", "TLSv1.3", "X25519MLKEM768", "XMSS", "bcprov-jdk18on", "chacha20poly1305", "golang.org/x/crypto", "libsodium", "node-forge",
)
REPORTED = (
    "aes256-gcm", "AES", "AES/GCM/NoPadding", "AES-128-GCM", "RSA", "RSA-4096", "RSA private key (PKCS#8)", "SHA256withRSA", "secp256r1", "P-256", "EdDSA", "Kyber768", "ML-KEM-512", "mldsa65", "DSA", "SHA-512",
    "sha_256", "TLS", "SSLv3", "1.3", "GCM", "DES", "seed_material", "SEED-CBC", "universal-hash", "Falcon", "lms_sha256_n32_h10", "XMSS-SHA2_10_256", "SPHINCS+", "crypto", "libsodium", "MD5", "relay-key.pem",
    "key@50ece37a", "x25519mlkem768", "HMAC-SHA256", "CSPRNG", "ARC4", "Camellia-256-CBC", "unknown", "node-forge",
)


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


class Frames:
    """The frames of one query. Those in `kept`, which a query uses more than once, are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.kept = {"credible"}
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = cut(make(), name) if name in self.kept else make()
        return self._made[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def plants(self) -> DataFrame:
        return self.table("part").selectExpr(
            "concat('p', p_partkey % 6) AS project", "p_partkey AS id", "concat('src/f', p_partkey div 8, '.c') AS file", "p_size AS line",
            f"element_at(array({quoted(PLANTED)}), cast(1 + p_partkey % {len(PLANTED)} AS int)) AS algorithm", "cast(1 + (p_partkey div 6) % 6 AS int) AS layer", "'algorithm' AS asset_type",
        )

    def accepted(self) -> DataFrame:
        own = self.plants().select("project", "id", "file", "line")
        other = self.table("part").filter("p_partkey % 10 = 0").selectExpr("concat('p', p_partkey % 6) AS project", "p_partkey AS id", "concat('src/f', (p_partkey + 8) div 8, '.c') AS file", "p_size + 5 AS line")
        return own.unionByName(other)

    def inputs(self) -> DataFrame:
        return self.table("orders").selectExpr("concat('p', o_custkey % 6, '__', o_orderpriority) AS source", "concat('p', o_custkey % 6) AS project", "concat('l', (o_custkey % 6) % 4) AS language", "o_orderpriority AS tool").distinct()

    def assets(self) -> DataFrame:
        pool, n = f"array({quoted(REPORTED)})", len(REPORTED)
        return self.table("orders").selectExpr(
            "concat('p', o_custkey % 6, '__', o_orderpriority) AS source", "o_orderkey AS index",
            f"CASE WHEN o_orderkey % 3 = 0 THEN array(element_at({pool}, cast(1 + o_orderkey % {n} AS int)), element_at({pool}, cast(1 + (o_orderkey div {n}) % {n} AS int))) ELSE array(element_at({pool}, cast(1 + o_orderkey % {n} AS int))) END AS names",
            "o_orderstatus = 'P' AS is_dependency",
        )

    def raw_claims(self) -> DataFrame:
        items = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        orders = self.table("orders").selectExpr("o_orderkey", "concat('p', o_custkey % 6, '__', o_orderpriority) AS source", "concat('p', o_custkey % 6) AS project")
        return items.join(orders, items.l_orderkey == orders.o_orderkey).selectExpr(
            "source", "project", "o_orderkey AS index", "l_linenumber AS ordinal",
            r"CASE l_linenumber % 7 WHEN 0 THEN NULL WHEN 1 THEN concat('/tmp/x/src/f', l_partkey div 8, '.c') WHEN 2 THEN concat('./src/f', l_partkey div 8, '.c') WHEN 3 THEN concat('src\\f', l_partkey div 8, '.c') WHEN 4 THEN concat(' f', l_partkey div 8, '.c ') ELSE concat('src/f', l_partkey div 8, '.c') END AS file",
            "CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_linenumber * 7 END AS line", "CASE WHEN l_linenumber % 2 = 0 THEN 'properties' ELSE 'evidence.occurrences' END AS shape",
        )

    def files(self) -> DataFrame:
        return self.accepted().select("project", F.col("file").alias("path")).distinct()

    def claims(self) -> DataFrame:
        return self._once("claims", lambda: score.resolve_claims(self.raw_claims(), self.inputs(), self.files()))

    def allowances(self) -> DataFrame:
        return self.spark.createDataFrame([("CSPRNG", None, None), ("GCM", None, None), ("MD5", "p1", "src/f3.c"), ("DES", "p2", None), ("SSLv3", "p0", "src/f5.c"), ("TLS", None, None)], "algorithm string, project string, file string")

    def credible(self) -> DataFrame:
        return self._once("credible", lambda: score.credible_algorithms(self.assets(), self.plants()))

    def hits(self) -> DataFrame:
        return self._once("hits", lambda: score.hits(self.inputs(), self.plants(), self.accepted(), self.assets(), self.claims(), self.credible()))

    def verdicts(self) -> DataFrame:
        return score.verdicts(self.inputs(), self.plants(), self.assets(), self.hits(), self.credible())
