import pytest
from pyspark.sql import functions as F

from acopio import constants as K
from acopio.functions.text import match_key
from acopio.operators import aggregates as A
from acopio.operators import cleaning as C
from acopio.operators import grid as G
from acopio.operators import joins as J
from acopio.operators import matching as M
from acopio.operators.counts import Counts
from acopio.plans import ingest as I
from acopio.plans import segmentation as S
from acopio.plans import star
from acopio.session import new_path
from acopio.sources.files import raw_grid, scan_master


def test_footer_rules(spark):
    rows = [(0, "", "", "", "", "", True), (1, "2020", "11", "Nota X", "5", "", False), (2, "", "Fuente: entidad", "", "", "", True),
            (3, "", "Corte definitivo para uso interno", "", "", "", True), (4, "", "abc", "", "", "", True), (5, "", "123", "", "", "", False),
            (6, "", "Total", "10", "20", "", True), (7, "", "11", "Alfa", "Oficial", "10", False)]
    df = spark.createDataFrame(rows, "_ord int, anio string, a string, b string, c string, d string, want boolean")
    got = C.with_footer_flag(df, ["anio", "a", "b", "c", "d"], "anio").orderBy("_ord").collect()
    assert [r._footer for r in got][:7] == [r.want for r in got][:7]


def test_footer_trim_keeps_rows_above_data(spark):
    rows = [(p, i, y, t) for p in ("f1", "f2") for i, (y, t) in enumerate([("2020", "a"), ("", "Fuente x"), ("2020", "b"), ("", "Nota y"), ("", "")])]
    df = spark.createDataFrame(rows, "_path string, _ord bigint, anio string, t string")
    out = C.trim_footer(df, "_ord", "_path", ["anio", "t"], "anio")
    assert sorted((r._path, r._ord) for r in out.collect()) == [(p, i) for p in ("f1", "f2") for i in range(3)]


def test_outer_merge_matches_null_keys(spark):
    a = spark.createDataFrame([("i1", "p1", None, 2)], "i string, p string, s string, admitidos bigint")
    b = spark.createDataFrame([("i1", "p1", None, 3), ("i1", "p2", "F", 1)], "i string, p string, s string, inscritos bigint")
    out = J.outer_merge([(a, "admitidos"), (b, "inscritos")], ["i", "p", "s"])
    assert sorted(map(tuple, out.collect()), key=str) == [("i1", "p1", None, 2, 3), ("i1", "p2", "F", 0, 1)]


def test_salted_join_equals_broadcast(spark, monkeypatch):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        want = sorted(map(str, J.attach(big, small, ["k"], how).collect()))
        monkeypatch.setattr(J, "BROADCAST_ROWS", 5)
        got = sorted(map(str, J.attach(big, small, ["k"], how).collect()))
        monkeypatch.undo()
        assert got == want


def test_salted_join_copies_are_never_broadcast(spark, monkeypatch):
    # a lookup that Spark takes for small enough to broadcast, past the measured bound: its copies are many times that
    monkeypatch.setattr(J, "BROADCAST_ROWS", 5)
    big = spark.range(300).select((F.col("id") % 50).alias("k"), "id")
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        out = J.attach(big, small, ["k"], how)
        assert out.count() == {"left": 300, "inner": 240, "left_semi": 240, "left_anti": 60}[how]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan, how


def test_rows_meet_only_the_codes_that_the_parent_lacks(spark, monkeypatch):
    df = spark.createDataFrame([("1", 1), ("1", 1), ("2", 2), ("9", 3), (None, 4)], "k string, v int")
    parent = spark.createDataFrame([("1",), ("2",), ("2",), (None,), ("5",)], "codigo string")
    known = spark.createDataFrame([("1",), ("2",), ("9",), ("8",), (None,)], "codigo string")
    seen, attach = [], J.attach
    monkeypatch.setattr(J, "attach", lambda big, small, *a, **b: seen.append(small.count()) or attach(big, small, *a, **b))
    want = [("1", 1), ("1", 1), ("2", 2)]
    assert sorted(map(tuple, J.fk_semi(df, "k", parent, "codigo").collect())) == want
    assert sorted(map(tuple, J.fk_semi(df, "k", parent, "codigo", among=known).collect())) == want
    assert seen == [3, 2]


def test_facts_lose_the_codes_without_a_name(spark, monkeypatch):
    cols = K.IES_COLUMNS + ["anio", "semestre", *K.ADMIN_MEASURES]
    base = dict.fromkeys(cols, "1")
    rows = [dict(base, institucion_codigo=c, institucion_nombre=n, _ord=i)
            for i, (c, n) in enumerate([("10", "Uno"), ("10.0", ""), ("20", " "), ("20", ""), ("", "Nadie"), (None, "Nadie"), ("30", "Tres")])]
    admin = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols) + ", _ord bigint")
    given, fk_semi = [], star.fk_semi
    monkeypatch.setattr(star, "fk_semi", lambda *a, **b: given.append(b.get("among")) or fk_semi(*a, **b))
    built = star.build_star({"Administrativos": admin})
    assert sorted(r.institucion_codigo for r in built["HECHO_ADMINISTRATIVOS"].collect()) == ["10", "30"]
    assert sorted(r.codigo for r in given[0].collect()) == ["10", "20", "30"]
    # a frame that gives the scan no entries says nothing of the codes
    built = star.build_star({"Administrativos": admin.drop("sector_ies")})
    assert given[1] is None and built["HECHO_ADMINISTRATIVOS"].count() == 0


def test_first_non_empty_and_parents(spark):
    cols = K.IES_COLUMNS
    base = dict.fromkeys(cols, "")
    rows = [dict(base, institucion_codigo="1", institucion_nombre="", municipio_ies_codigo="5", ies_padre_codigo="1", _ord=0),
            dict(base, institucion_codigo="1.0", institucion_nombre="Alfa", municipio_ies_codigo="6", ies_padre_codigo="9", _ord=1),
            dict(base, institucion_codigo="0", institucion_nombre="Nada", _ord=2),
            dict(base, institucion_codigo="2", institucion_nombre=" ", _ord=3),
            dict(base, institucion_codigo="3", institucion_nombre="Beta", ies_padre_codigo="1", _ord=4)]
    df = spark.createDataFrame([tuple(r[c] for c in ["_ord", *cols]) for r in rows], "_ord bigint, " + ", ".join(f"{c} string" for c in cols))
    raw = star.dim_institution([df])
    got = {r.codigo: r for r in raw.collect()}
    assert set(got) == {"1", "3"} and got["1"].nombre == "Alfa" and got["1"].municipio_codigo == "5"
    assert got["1"].ies_padre_codigo == "9"
    fixed = {r.codigo: r.ies_padre_codigo for r in star.with_valid_parents(raw).collect()}
    assert fixed == {"1": None, "3": "1"}


def test_collation_dedupe(spark):
    df = spark.createDataFrame([(1, "Ingeniería"), (2, "INGENIERIA"), (3, "ingenieria "), (4, "Artes")], "_ord bigint, n string")
    assert sorted(r.n for r in A.distinct_first(df, "n", "_ord").collect()) == ["Artes", "Ingeniería"]


def test_numbering_in_ranges_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("o"))
    ranged = A.number_rows(df, ["o"]).orderBy("o").collect()
    assert [r.id for r in ranged] == list(range(1, 1001))


def test_numbering_splits_a_tied_first_column(spark):
    df = spark.range(4000).select(F.lit(1 << 62).alias("o"), (F.col("id") * 7 % 4000).alias("p"))
    got = A.number_rows(df, ["o", "p"]).orderBy("p").collect()
    assert [r.id for r in got] == list(range(1, 4001))
    assert A.number_rows(df.limit(0), ["o", "p"]).collect() == []


def test_quantiles_exact(spark):
    df = spark.range(1, 1001).select((F.col("id") * F.col("id") % 977).cast("double").alias("x"))
    want = df.toPandas()["x"].quantile([0.1, 0.25, 0.5, 0.9]).round(9).tolist()
    got = [round(r.valor, 9) for r in A.quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.9]).orderBy("prob").collect()]
    assert got == want


def test_quantiles_of_odd_values(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    cols = {"same": np.full(500, 7.25), "wide": np.concatenate([-(10.0 ** rng.uniform(-300, 300, 250)), 10.0 ** rng.uniform(-300, 300, 250)]),
            "near": 1e15 + rng.integers(0, 40, 500) / 8, "tiny": rng.choice([5e-324, -5e-324, 0.0, -0.0, 1e-310], 500),
            "ints": rng.integers(-1000, 1000, 500).astype(float), "ends": rng.choice([float("inf"), -float("inf"), 1.0], 500, p=[.2, .2, .6])}
    names = list(cols)
    df = spark.createDataFrame([tuple(float(cols[c][i]) for c in names) for i in range(500)], ", ".join(f"{c} double" for c in names))
    probs = [0.0, 0.01, 0.25, 0.5, 0.777, 1.0]
    got = {(r.columna, r.prob): r.valor for r in A.quantiles(df, names, probs).collect()}
    for c in names:
        ordered = np.sort(cols[c])
        for p in probs:
            at = p * 499
            lo, hi, part = ordered[int(np.floor(at))], ordered[int(np.ceil(at))], at - np.floor(at)
            assert got[(c, p)] == pytest.approx(lo if lo == hi else lo * (1 - part) + hi * part, rel=1e-12), (c, p)
    assert A.quantiles(df.limit(0), names, probs).collect() == []


def test_counts_come_with_the_result(spark):
    counts = Counts()
    foot = [("f1", 0, "2020", "a"), ("f1", 1, "", "Fuente x"), ("f2", 0, "", "Nota y"), ("f2", 1, "", "")]
    df = spark.createDataFrame(foot, "_path string, _ord bigint, anio string, t string")
    out = counts.written(C.nullify_tokens(C.trim_footer(df, "_ord", "_path", ["anio", "t"], "anio", counts), counts=counts))
    assert out.count() == 1 and counts.get() == {"recortadas": 3, "n_vacias": 0, "n_sin_info": 0}
    keys = spark.createDataFrame([("a", "b"), ("b", "b"), ("c", "z"), ("d", None)], "codigo string, ies_padre_codigo string")
    for call, n in ((lambda k: J.fk_semi(keys, "ies_padre_codigo", keys, "codigo", counts=k), {"descartadas": 2}),
                    (lambda k: J.fk_nullify(keys, "ies_padre_codigo", keys, "codigo", counts=k), {"anuladas": 1}),
                    (lambda k: star.valid_parent_links(keys, counts=k), {"omitidas": 2})):
        counts = Counts()
        rows = counts.written(call(counts)).count()
        assert counts.get() == n and rows == {"descartadas": 2, "anuladas": 4, "omitidas": 1}[next(iter(n))]


def test_greedy_match_is_one_to_one(spark):
    heads = ["Código de la Institución", "Sexo", "ID Sexo", "Admisiones 2018", "AÑO", "Año", "Semestre"]
    df = spark.createDataFrame([("f", i, h) for i, h in enumerate(heads)], "file string, pos int, name string")
    canon = K.CANONICAL_HEADERS["Estudiantes admitidos"]
    out = M.match_columns(M.match_scores(df, canon, ["file"]), ["file"], len(canon)).collect()
    assert len({r.canon_idx for r in out}) == len(out) == len({r.src_idx for r in out})
    by = {canon[r.canon_idx]: heads[r.src_idx] for r in out}
    assert by["SEXO"] == "Sexo" and by["ADMITIDOS"] == "Admisiones 2018" and by["AÑO"] == "AÑO"


def test_variants_join_first_leader(spark):
    vals = ["Universidad Nacional"] * 5 + ["Universidad Nacionl"] * 2 + ["UNIVERSIDAD NACIONAL"] + ["Otra cosa"] * 3
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "_ord bigint, programa string")
    out = {r.valor_actual: (r.valor_canonico, r.frecuencia_actual) for r in M.variant_report(df, ["programa"], "_ord").collect()}
    assert out == {"Universidad Nacionl": ("Universidad Nacional", 2), "UNIVERSIDAD NACIONAL": ("Universidad Nacional", 1)}
    assert M.variant_report(df, ["programa"], "_ord", max_distinct=3).count() == 0


def test_variants_of_all_values_are_those_of_a_plain_fold(spark):
    import random
    rng, words = random.Random(8), ["universidad", "del", "norte", "nacional", "instituto", "sur", "de", "artes", "oriente"]
    names = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(80)]
    vals = []
    for _ in range(160):
        v = list(rng.choice(names))
        for _ in range(rng.randint(0, 4)):
            v.insert(rng.randrange(len(v) + 1), rng.choice("aeiostn "))
        vals.append("".join(v))
    vals += ["", " ", ".", None]
    df = spark.createDataFrame(list(enumerate(vals)), "_ord bigint, programa string")
    counts = A.value_counts(df, ["programa"], "_ord").select("valor", "frecuencia", "primera", match_key(F.col("valor")).alias("k")).collect()
    ranked = sorted(counts, key=lambda r: (-r.frecuencia, r.primera, r.valor))

    def ratio(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return 1.0 if a == b else 1 - row[-1] / max(len(a), len(b))
    for t in (0.85, 0.6):
        leaders, want, near = [], {}, set()
        for i, r in enumerate(ranked):
            near |= {(q.valor, r.valor) for q in ranked[:i] if ratio(q.k, r.k) >= t}
            lead = next((g for g in leaders if ratio(g.k, r.k) >= t), None)
            leaders += [] if lead else [r]
            want |= {r.valor: lead.valor} if lead else {}
        assert {r.valor_actual: r.valor_canonico for r in M.variant_report(df, ["programa"], "_ord", t).collect()} == want
        assert {(r.a, r.b) for r in M.fuzzy_pairs(df, ["programa"], "_ord", t).collect()} == near


def one_after_another(rules, values):
    """(column, value) -> value after every chosen rule, the plain way."""
    out = {}
    for column, value in values:
        now = value
        for _, c, actual, canonical, chosen, turned in sorted(rules):
            src, dst = (canonical, actual) if turned else (actual, canonical)
            if c == column and chosen and now == src:
                now = dst
        out[(column, value)] = now
    return out


RULES = "pos bigint, columna string, valor_actual string, valor_canonico string, aplicar boolean, invertir boolean"


def test_keys_with_a_common_word_do_not_crowd(spark):
    import random
    rng = random.Random(5)
    made, some = set(), set()
    while len(made) < 2500:
        rest = "".join(rng.choices("abcdefghijklmnop", k=rng.randint(9, 16)))
        family = [f"universidad {rest}", f"universidad {rest[:4]}{rng.choice('xyz')}{rest[5:]}", f"universida {rest}z"]
        made |= set(family)
        some |= set(family) if len(some) < 300 else set()
    df = spark.createDataFrame([("c", k) for k in made], "columna string, k string")
    met = M.meeting_keys(df, 0.85).count()
    assert met < 60 * len(made)         # every two keys share the first word: 3 million pairs
    some = sorted(some) + ["a", "ab", "abc", "universidad", "universidad a"]
    got = {(r.a, r.b) for r in M.similar_keys(spark.createDataFrame([("c", k) for k in some], "columna string, k string"), 0.85).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]
    want = {frozenset((a, b)) for i, a in enumerate(some) for b in some[:i] if abs(len(a) - len(b)) < 6 and 1 - distance(a, b) / max(len(a), len(b)) >= 0.85}
    assert {frozenset(p) for p in got} == want and len(got) == len(want) > 150


def test_corrections_compose(spark):
    def resolved(*rules):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "pos int, columna string, valor_actual string, valor_canonico string, invertir boolean")
        return sorted(map(tuple, J.resolved_corrections(df).collect()))
    assert resolved(("c", "a", "b", False), ("c", "b", "d", False)) == [("c", "a", "d"), ("c", "b", "d")]
    assert resolved(("c", "a", "b", True)) == [("c", "b", "a")]
    assert resolved(("c", "a", "b", False), ("c", "b", "a", False)) == [("c", "b", "a")]
    assert resolved(("c", "a", None, False), ("c", None, "b", False), ("c", "a", "a", False)) == [] == resolved()


def test_corrections_are_applied_one_after_another(spark):
    import random
    rng = random.Random(3)
    rules = [(i * 3, rng.choice("xy"), f"v{rng.randrange(40)}", f"v{rng.randrange(40)}", rng.random() < .8, rng.random() < .3) for i in range(150)]
    rules += [(1000 + i, "x", f"c{i}", f"c{i + 1}", True, False) for i in range(100)]      # a long chain
    rules += [(2000 + i, "y", f"s{i}", "hub", True, None) for i in range(60)] + [(2030, "y", "hub", "early", True, False), (3000, "y", "hub", "late", True, False)]
    values = {(c, v) for _, c, a, b, _, _ in rules for v in (a, b)} | {("x", None), ("y", "other")}
    want = one_after_another([(*r[:5], bool(r[5])) for r in rules], values)
    df = spark.createDataFrame([(c, v, 2020) for c, v in values], "col string, v string, anio int")
    corrections = spark.createDataFrame(rules, RULES)
    wide = df.select("col", "v", "anio", *[F.when(F.col("col") == c, F.col("v")).alias(c) for c in "xy"])
    got = {(r.col, r.v): r[r.col] for r in J.apply_corrections(wide, corrections).collect()}
    assert got == want
    none = J.apply_corrections(wide, corrections, scope=F.col("anio") == 1999).collect()
    assert all(r[r.col] == r.v for r in none)


def test_scoped_clean_leaves_other_years(spark):
    df = spark.createDataFrame([("2020", " N/A "), ("2019", " N/A ")], "anio string, t string")
    out = {r.anio: r.t for r in C.scoped(df, C.nullify_tokens, C.in_year("anio", 2020)).collect()}
    assert out == {"2020": None, "2019": " N/A "}


def test_upsert_replaces_only_its_years(spark):
    root = new_path(spark, "t")
    df = spark.createDataFrame([("D", 2020, "a"), ("D", 2021, "a")], "tipo string, anio int, f string")
    I.upsert_by_year(df, root)
    new = spark.createDataFrame([("D", 2020, "b")], "tipo string, anio int, f string")
    for _ in range(2):
        I.upsert_by_year(new, root)
    I.upsert_by_year(spark.createDataFrame([("D", 2021, "z"), ("D", 2022, "z")], df.schema), root, on_duplicate="skip")
    assert sorted((r.anio, r.f) for r in I.read_master(spark, root).collect()) == [(2020, "b"), (2021, "a"), (2022, "z")]


def test_header_row_and_titles(spark):
    rows = [("f", 0, ["Informe", None, None]), ("f", 1, ["Corte 2018", None, None]), ("f", 2, ["Código de la Institución", "Nombre", "Total"]), ("f", 3, ["11", "Alfa", "3"])]
    grid = spark.createDataFrame(rows, "_path string, _ord bigint, cells array<string>").withColumn("_sheet", F.lit("0"))
    assert G.detect_header_row(grid).first().header_idx == 2
    assert G.grid_title(grid).first().titulo == "Corte 2018"
    assert G.file_year(grid).first().anio == 2018


def test_star_load_is_versioned(spark):
    root = new_path(spark, "star")
    dep = spark.createDataFrame([("05", "Antioquia")], "codigo string, nombre string")
    star.write_star({"DEPARTAMENTO": dep}, root)
    star.write_star({"DEPARTAMENTO": dep.union(spark.createDataFrame([("11", "Bogotá")], dep.schema))}, root)
    assert star.current_star(spark, root)["DEPARTAMENTO"].count() == 2
    assert star.constraint_violations({"DEPARTAMENTO": dep}).where("n > 0").count() == 0


def test_silhouette_is_that_of_all_pairs(spark):
    pts = [(i, float(i % 7), float(i * i % 11), 9 if i == 59 else i % 3) for i in range(60)]
    df = spark.createDataFrame(pts, "id bigint, x double, y double, c int")
    got = {r.id: r.silueta for r in S.silhouette_samples(df, "id", "c", ["x", "y"]).collect()}
    for i, x, y, c in pts:
        of = {k: [(x - u) ** 2 + (y - v) ** 2 for j, u, v, d in pts if d == k and j != i] for k in (0, 1, 2, 9)}
        a, b = of[c] and sum(of[c]) / len(of[c]), min(sum(d) / len(d) for k, d in of.items() if k != c)
        assert got[i] == pytest.approx((b - a) / max(a, b) if of[c] else 0.0, abs=1e-9)


def test_kmeans_cost_falls_with_k(spark):
    df = spark.createDataFrame([(i, float(i % 5), float(i % 3 * 10)) for i in range(90)], "id bigint, a double, b double")
    rows = S.kmeans_sweep(df, ["a", "b"], ks=(2, 3, 4), inits=2).orderBy("k").collect()
    assert rows[0].inercia >= rows[1].inercia >= rows[2].inercia
    sizes = S.cluster_sizes(S.kmeans_assign(df, "id", ["a", "b"], inits=2))
    assert sizes.agg(F.sum("n")).first()[0] == 90


def test_year_column_by_name_then_text(spark):
    df = spark.createDataFrame([(0, "a", "Corte 2018"), (1, "b", "Corte 2018")], "_ord bigint, x string, y string")
    assert G.master_year_column(df) == "y"
    assert G.master_year_column(df.withColumnRenamed("x", "Anio")) == "Anio"
    assert G.master_year_column(df.withColumnRenamed("x", "AÑO")) == "AÑO"
    assert G.master_year_column(df.drop("y")) is None


def test_features_file(spark, tmp_path):
    from acopio.sources.files import read_features
    f = tmp_path / "f.csv"
    f.write_text(";".join(["Nombre_IES", "Departamento", *K.FEATURES]) + "\nAlfa;Antioquia;1;2;3;4;5;0.5;0.6;;0.1\n", "utf-8")
    row = S.feature_table(read_features(spark, str(f)), "Nombre_IES").first()
    assert row.Total_Admitidos == 4.0 and row.Tasa_Absorcion == 0.0


def test_footer_inside_base_clean(spark):
    rows = [("f", 0, "2020", "Institución Á", "Hombre"), ("f", 1, "", "Fuente: x", ""), ("f", 2, "2021.0", "N/A", "F"), ("f", 3, "", "Nota y", "")]
    df = spark.createDataFrame(rows, "_path string, _ord bigint, `Año` string, `Institución` string, `Sexo` string")
    out = [tuple(r)[2:] for r in C.base_clean(df).orderBy("_ord").collect()]
    assert out == [(2020, "INSTITUCION A", "Masculino"), (0, "FUENTE: X", None), (2021, None, "Femenino")]


def test_hot_file_and_hot_key_keep_every_row(spark):
    """One file and one key hold most rows; nothing is lost or doubled."""
    grid = spark.range(5000).select(F.when(F.col("id") < 4500, "big").otherwise(F.concat(F.lit("f"), (F.col("id") % 7).cast("string"))).alias("_path"),
                                    F.col("id").alias("_ord"), F.lit("2020").alias("anio"), F.col("id").cast("string").alias("v"))
    assert C.trim_footer(grid, "_ord", "_path", ["anio", "v"], "anio").count() == 5000
    heads = G.head_rows(grid.withColumn("cells", F.array("v")), 3)
    assert heads.count() == 3 * 8


def test_separators_inside_texts_make_no_columns(spark, tmp_path, monkeypatch):
    from acopio.sources import files
    rows = [("1", "a, " * 900), ("2", 'x "y"\n' + "," * 700), ("3", ""), ("4", "plain")]
    files.write_csv(spark.createDataFrame(rows, "id string, texto string"), str(tmp_path / "many"))
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "a.csv").write_text('id,texto\n5,"' + ",;" * 800 + '"\n6\n7,b,c\n')
    widths, cells = [], files._cells
    monkeypatch.setattr(files, "_cells", lambda records, sep, width: widths.append(width) or cells(records, sep, width))
    got = {tuple(r) for r in scan_master(spark, [str(tmp_path / "many"), str(tmp_path / "flat")]).collect()}
    assert got == {*rows, ("5", ",;" * 800), ("6", ""), ("7", "b")}
    assert max(widths) == 2


def test_wide_records_that_span_lines_keep_every_column(spark, tmp_path):
    head = ",".join(f'"c{i}\nx, {i}"' if i % 50 == 0 else f"c{i}" for i in range(300))
    (tmp_path / "a.csv").write_text(f"title\n{head}\n1,,3\n")
    rows = [r.cells for r in raw_grid(spark, [str(tmp_path)]).orderBy("_ord").collect()]
    assert [len([c for c in r if c]) for r in rows] == [1, 300, 2]
    assert rows[1][250] == "c250\nx, 250" and rows[1][299] == "c299" and rows[2][:3] == ["1", "", "3"]


def test_masters_are_read_by_their_own_headers(spark, tmp_path):
    for name, text in {"1": "x,y\n1,2\n3,\n", "2": "y,x\n4,5\n", "3": 'x,z\n"a\nb",7\n', "4": "x,y\n8,9\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    got = scan_master(spark, str(tmp_path))
    assert sorted(got.columns) == ["x", "y", "z"]
    assert {(r.x, r.y, r.z) for r in got.collect()} == {("1", "2", ""), ("3", "", ""), ("5", "4", ""), ("a\nb", "", "7"), ("8", "9", "")}
    assert {tuple(r) for r in scan_master(spark, str(tmp_path), ["y", "x"]).where("x = '5'").collect()} == {("4", "5")}


def test_many_files_of_every_kind_in_one_plan(spark, tmp_path):
    """Encodings, headers, blank lines, quotes and records over several lines, against Python's own reader."""
    import csv
    import random
    rng, want = random.Random(6), []
    for i in range(60):
        names = rng.choice([["a", "b", "c"], ["b", "a", "ñ"], ["a", "c", "", "ñ"], ["c", "C", "b"]])
        rows = [[rng.choice(["", "x", "Peña", 'q"t', "1,5", "  s ", f"v{i}", *(["two\nlines", "\n\nlong\n"] if i % 3 == 0 else [])]) for _ in names] for _ in range(rng.randrange(0, 12))]
        rows = [r if any(c.strip() for c in r) else ["y", *r[1:]] for r in rows]
        ragged = [r[:rng.randrange(1, len(r) + 1)] if rng.random() < .2 and r[0] else r for r in rows]
        with open(tmp_path / f"f{i}.csv", "w", encoding="latin-1" if i % 7 == 1 else "utf-8", newline="") as f:
            out = csv.writer(f, lineterminator="\r\n" if i % 2 else "\n")
            out.writerow(names)
            for r in ragged:
                out.writerow(r)
                if rng.random() < .1 and i % 3:
                    f.write("\n")
        low = [n.lower() for n in names]
        shown = [f"_c{k}" if not n else f"{n}{k}" if low.count(n.lower()) > 1 else n for k, n in enumerate(names)]
        if i % 7 != 1:
            want += [{n: (r[k] if k < len(r) else "") for k, n in enumerate(shown)} for r in ragged]
    (tmp_path / "empty.csv").write_text("")
    grid = raw_grid(spark, [str(tmp_path)])
    assert grid.select("_path").distinct().count() == 60
    assert {c for r in grid.collect() for c in r.cells if "ñ" in c} <= {"Peña", "ñ"}
    utf = [str(tmp_path / f"f{i}.csv") for i in range(60) if i % 7 != 1]
    got = scan_master(spark, utf)
    assert sorted(got.columns) == sorted({c for r in want for c in r})
    key = lambda d: tuple(sorted((k, v) for k, v in d.items() if v))
    assert sorted(key(r.asDict()) for r in got.collect()) == sorted(map(key, want))
