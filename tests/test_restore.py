from pyspark.sql import functions as F

from veilframe.functions.registry import BY_NAME
from veilframe.operators.apply import restore, tokenize
from veilframe.operators.detect import detect
from veilframe.operators.resolve import resolve

TEXTS = ["mail a@b.org and {{EMAIL_x y_1}} a@b.org", "{{EMAIL_k-1_1}} {{{a@b.org}}} {", "{﷐{ {﷐ {{{{ c@d.org", "no mail {{", "a@b.org{{c@d.org}}"]


def test_restore_with_text_scopes_and_literal_tokens(spark):
    rows = [(scope, t) for t in TEXTS for scope in ("k-1", "x y", "a{b}_1", "é")]
    df = spark.createDataFrame(rows, "scope string, text string")
    done = tokenize(resolve(detect(df, [BY_NAME["email"]])), "scope")
    for r in restore(done).collect():
        assert r.restored == r.text and "a@b.org" not in r.redacted and "c@d.org" not in r.redacted, (r.text, r.redacted, r.restored)


def test_many_spans_resolve_in_good_time(spark):
    import time

    text = "".join(f"{10000 + i} a{i}@b.org " for i in range(8000))
    df = spark.createDataFrame([(text,)], "text string")
    began = time.time()
    out = resolve(detect(df, [BY_NAME["zip"], BY_NAME["email"]])).select(F.size("spans").alias("n")).first()
    assert out.n == 16_000 and time.time() - began < 60
