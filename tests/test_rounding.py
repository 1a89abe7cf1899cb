"""Results that a rounding decides: sums must not depend on the order of the rows."""

import duckdb
from gradus.functions import formulas as M
from gradus.plans import models
from pyspark.sql import functions as F

#: event_id - 4,400,000, minute, k and correctness of one learner, whose index is 70.5 but for the last bits of its parts.
EVENTS = """
    29978:12974:49:1 29848:12920:10:1 29701:12860:17:0 28686:12426:83:0 60015:25916:56:1 73498:31765:3:1 73051:31580:82:1 72370:31292:89:1 80592:34793:22:0 12005:5228:10:1 10597:4612:45:1
    61343:26475:86:0 59146:25539:64:1 58848:25410:48:1 58159:25117:5:1 61685:26620:41:1 14581:6348:41:0 75464:32616:17:0 74507:32193:74:1 10214:4433:84:0 9695:4206:45:1 54750:23586:1:1
    54794:23605:65:0 38459:16586:29:1 64896:28020:58:0 63519:27420:3:0 37135:16013:92:0 94586:40875:60:1 95567:41288:94:1 1600:670:48:1 83924:36233:61:1 50157:21607:76:1 50701:21832:6:0
    51173:22029:13:0 83022:35850:35:1 44592:19174:23:1 44495:19130:50:1 44372:19076:5:1 30877:13342:61:1 31876:13757:60:1 92191:39818:68:1 93877:40558:74:0 40650:17498:6:0 40440:17405:3:1
    39923:17191:95:0 39766:17131:32:0 48212:20753:66:0 47761:20554:96:0 76184:32931:82:0 76292:32968:14:1 77817:33615:49:1 42183:18153:12:1 94189:40696:15:0 3787:1651:45:1 3673:1598:38:0
    2748:1179:49:1 86114:37193:52:1 85127:36752:33:1 84610:36521:64:1 84007:36258:77:1 70792:30640:10:0 69895:30231:91:0 69651:30119:88:1 6872:2997:34:1 22997:9950:29:1 69276:29958:21:0
    69301:29970:35:0 88466:38221:76:0 88772:38354:10:1 90075:38926:65:1 90764:39225:5:0 46211:19888:24:0 46807:20144:60:1 78564:33943:86:1 78464:33894:98:1 18736:8129:68:1 25128:10904:32:1
"""


def test_sai_near_a_half(spark, tmp_path):
    rows = [[int(x) for x in e.split(":")] for e in EVENTS.split()]
    values = ", ".join(f"({4400000 + i}, timestamp '2024-01-01' + interval {m} minute, 67109, 'view', {30.0 if ok else 90.0}::double, '{{\"k\": {k}}}')" for i, m, k, ok in rows)
    duckdb.sql(f"copy (select event_id::bigint as event_id, ts, user_id::bigint as user_id, event_type, value, props from (values {values}) as t(event_id, ts, user_id, event_type, value, props)) to '{tmp_path}/events.parquet'")
    ours = models.sai(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    assert [tuple(r) for r in ours] == con.sql(models.SQL["sai"]).fetchall()


def test_exact_mean_in_any_order(spark):
    values = [0.1 * i for i in range(1, 30)] + [1e-9, 0.7, None]
    means = {spark.createDataFrame([(v,) for v in order], "v double").coalesce(1).agg(M.exact_mean(F.col("v"))).first()[0] for order in (values, values[::-1], sorted(values, key=lambda v: (v is None, -(v or 0) % 0.3)))}
    assert len(means) == 1
    assert spark.range(1).agg(M.exact_mean(F.lit(None).cast("double"))).first()[0] is None
