"""Which addresses may be fetched."""

from pyspark.sql import functions as F

from notelode.operators.review import host_of, safe_url

SAFE = ["http://example.org/a", "https://user:pass@example.org:8443/x?y#z", "HTTPS://Example.ORG", "http://8.8.8.8/", "http://[2001:db8:1::1]/", "http://192.0.3.1/", "http://100.128.0.1/", "https://localhosting.com/", "http://3com.com", "http://10.example.org/"]
UNSAFE = [
    None, "", "ftp://example.org", "file:///etc/passwd", "http://", "http://localhost/", "http://x.localhost:80/", "http://printer.local/", "http://x@127.0.0.1/", "http://example.org@10.0.0.1/", "http://[::1]/", "http://[fe80::1]/", "http://[fd00::1]/",
    "http://[::ffff:127.0.0.1]/", "http://0.0.0.0/", "http://0/", "http://2130706433/", "http://0x7f000001/", "http://0177.0.0.1/", "http://127.1/", "http://127.0.0.1./", "http://169.254.169.254/latest", "http://172.31.255.1/", "http://192.168.1.1",
    "http://100.64.0.1/", "http://198.18.0.1/", "http://224.0.0.1/", "http://255.255.255.255/", "http://256.1.1.1/", "http://local host/", "http://127.0.0.1\\@example.org/", "http://%31%32%37.0.0.1.x%20/",
]


def test_urls(spark):
    df = spark.createDataFrame([(u,) for u in SAFE + UNSAFE], "u string").select("u", safe_url(F.col("u")).alias("safe"), host_of(F.col("u")).alias("host"))
    rows = df.collect()
    assert not [r.u for r in rows if r.safe is not (r.u in SAFE)]
    assert {r.u: r.host for r in rows}[SAFE[1]] == "example.org"
