"""Scalar functions on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinityloom.functions import affinity as A
from affinityloom.functions import binning as B
from affinityloom.functions import classify as C
from affinityloom.functions import hashing as H
from affinityloom.functions import keys as K
from affinityloom.functions import quality as Q
from affinityloom.functions import structure as S
from affinityloom.functions import text as T
from affinityloom.functions import vocab as V
from affinityloom.plans.registry import query, table


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def pick(values, index):
    """Element of a fixed list by a row number (0-based, modulo)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def sql_pick(values, index: str) -> str:
    return f"({sql_list(values)})[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


LINE_KEY_SQL = """
  SELECT l_orderkey, l_linenumber, l_partkey,
         CASE l_linenumber % 3 WHEN 0 THEN 'protein_ligand' WHEN 1 THEN 'protein_protein' ELSE 'mutation_ddg' END AS task,
         CASE WHEN l_linenumber % 3 = 0 THEN
           concat_ws('|', 'protein_ligand', 'E' || l_orderkey,
             CASE WHEN l_returnflag <= l_linestatus THEN l_returnflag || ',' || l_linestatus
                  ELSE l_linestatus || ',' || l_returnflag END,
             'L' || l_partkey, CASE WHEN l_partkey % 2 = 0 THEN 'A' || l_suppkey || 'V' ELSE 'wt_or_unspecified' END)
         WHEN l_linenumber % 3 = 1 THEN
           concat_ws('|', 'protein_protein', 'E' || l_orderkey,
             least(CASE WHEN l_returnflag <= l_linestatus THEN l_returnflag || ',' || l_linestatus
                        ELSE l_linestatus || ',' || l_returnflag END, 'P'),
             greatest(CASE WHEN l_returnflag <= l_linestatus THEN l_returnflag || ',' || l_linestatus
                        ELSE l_linestatus || ',' || l_returnflag END, 'P'),
             CASE WHEN l_partkey % 2 = 0 THEN 'A' || l_suppkey || 'V' ELSE 'wt_or_unspecified' END)
         ELSE concat_ws('|', 'mutation_ddg', 'E' || l_orderkey, 'R' || l_linenumber,
             CASE WHEN l_partkey % 2 = 0 THEN 'A' || l_suppkey || 'V' ELSE 'wt_or_unspecified' END) END AS pair_key
  FROM lineitem
"""


def line_keys(spark, sf_dir):
    n = F.col("l_linenumber") % 3
    task = F.when(n == 0, "protein_ligand").when(n == 1, "protein_protein").otherwise("mutation_ddg")
    mutation = F.when(F.col("l_partkey") % 2 == 0,
                      F.concat(F.lit("A"), F.col("l_suppkey").cast("string"), F.lit("V"))).otherwise("")
    key = K.pair_identity_key(
        task, F.concat(F.lit("E"), F.col("l_orderkey").cast("string")),
        F.array("l_returnflag", F.concat(F.lit(" "), F.col("l_linestatus"))), F.array(F.lit("P"), F.lit(" ")),
        [F.lit(""), F.concat(F.lit("L"), F.col("l_partkey").cast("string"))],
        F.concat(F.lit("R"), F.col("l_linenumber").cast("string")), [mutation, F.lit(None).cast("string")],
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", task.alias("task"),
                                                   key.alias("pair_key"))


@query("pair_identity_keys", "G1 G3", LINE_KEY_SQL)
def pair_identity_keys(spark, sf_dir):
    return line_keys(spark, sf_dir)


@query("parsed_pair_keys", "G2 G17 G18",
       f"""SELECT l_orderkey, l_linenumber, split_part(pair_key, '|', 2) AS entry,
         CASE WHEN task = 'mutation_ddg' THEN split_part(pair_key, '|', 3) ELSE split_part(pair_key, '|', 4) END AS subject,
         CASE WHEN task = 'mutation_ddg' THEN '' ELSE split_part(pair_key, '|', 3) END AS receptor,
         CASE WHEN task = 'protein_protein' THEN split_part(pair_key, '|', 4) ELSE '' END AS partner,
         CASE WHEN task = 'protein_ligand' THEN split_part(pair_key, '|', 4) END AS ligand,
         CASE WHEN pair_key LIKE '%wt_or_unspecified' THEN 'wildtype_family' ELSE 'mutant_family' END AS family
       FROM ({LINE_KEY_SQL})""")
def parsed_pair_keys(spark, sf_dir):
    p = line_keys(spark, sf_dir).withColumn("p", K.parse_pair_key("pair_key"))
    return p.select(
        "l_orderkey", "l_linenumber", F.col("p.entry").alias("entry"), F.col("p.subject").alias("subject"),
        F.array_join("p.receptor", ",").alias("receptor"), F.array_join("p.partner", ",").alias("partner"),
        F.col("p.ligand").alias("ligand"), K.mutation_family(F.col("p.mutation")).alias("family"),
    )


@query("pair_family_keys", "G18",
       f"""SELECT l_orderkey, l_linenumber,
         CASE WHEN task = 'protein_ligand' THEN concat_ws('|', task, 'P' || l_partkey, split_part(pair_key, '|', 4))
              WHEN task = 'protein_protein' THEN concat_ws('|', task, 'P' || l_partkey, split_part(pair_key, '|', 4))
              ELSE concat_ws('|', task, 'P' || l_partkey, '-') END AS family_key,
         'family:P' || l_partkey || '|mutation:' || CASE WHEN l_linenumber = 1 THEN 'wt' ELSE 'M' || l_linenumber END AS group_key
       FROM ({LINE_KEY_SQL})""")
def pair_family_keys(spark, sf_dir):
    p = line_keys(spark, sf_dir).withColumn("p", K.parse_pair_key("pair_key"))
    receptor = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    mutation = F.when(F.col("l_linenumber") > 1, F.concat(F.lit("M"), F.col("l_linenumber").cast("string")))
    return p.select(
        "l_orderkey", "l_linenumber",
        K.pair_family_key(F.col("task"), receptor, F.coalesce("p.ligand", F.lit("")), F.array_join("p.partner", ","))
        .alias("family_key"),
        K.hard_group_key(F.col("pair_key"), receptor, mutation, F.col("p.entry")).alias("group_key"),
    )


@query("affinity_text_parsed", "G4",
       """WITH t AS (SELECT event_id, value, (['<= ', '>', '~', ''])[CAST(event_id % 4 AS INTEGER) + 1] AS rel,
                     (['pM', 'nM', 'uM', 'mM', 'M', 'mg/mL'])[CAST(event_id % 6 AS INTEGER) + 1] AS unit,
                     ([0.001, 1.0, 1000.0, 1000000.0, 1000000000.0, NULL]::DOUBLE[])[CAST(event_id % 6 AS INTEGER) + 1] AS f
                     FROM events)
       SELECT event_id, value AS number, unit, CASE rel WHEN '<= ' THEN '<=' WHEN '>' THEN '>' WHEN '~' THEN 'approx' END AS relation,
         round(value * f, 6) AS standardized,
         CASE WHEN round(value * f, 6) > 0 THEN round(log10(round(value * f, 6)), 6) END AS log10_nm FROM t""")
def affinity_text_parsed(spark, sf_dir):
    n = F.col("event_id")
    rel = pick(["<= ", ">", "~", ""], n)
    unit = pick(["pM", "nM", "uM", "mM", "M", "mg/mL"], n)
    raw = F.concat(rel, F.col("value").cast("string"))
    return table(spark, sf_dir, "events").withColumn("a", A.parse_affinity(raw, unit)).select(
        "event_id", F.col("a.value").alias("number"), F.col("a.unit").alias("unit"), F.col("a.relation").alias("relation"),
        F.col("a.standardized").alias("standardized"), F.round("a.log10", 6).alias("log10_nm"),
    )


@query("site_residue_tokens", "G5",
       r"""SELECT conv_id, turn, len(list_filter(regexp_split_to_array(trim(text, E' \t\r\n'), '[,\s;]+'), lambda x: x <> '')) AS residue_count,
         md5(array_to_string(list_transform(list_filter(list_transform(list_filter(
           regexp_split_to_array(trim(text, E' \t\r\n'), '[,\s;]+'), lambda x: x <> ''), lambda x: regexp_replace(x, '\P{L}', '', 'g')),
           lambda x: x <> ''), lambda x: replace(replace(upper(left(x, 3)), 'ß', 'SS'), 'ẞ', 'SS')), ' ')) AS names_md5 FROM conversations""")
def site_residue_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.size(T.site_residue_tokens("text")).cast("bigint").alias("residue_count"),
        F.md5(F.array_join(T.site_residue_names("text"), " ")).alias("names_md5"),
    )


@query("ddg_from_constants", "G6",
       """SELECT event_id, round(1.987e-3 * t * ln(value / k), 6) AS ddg, CAST(round(t - 273.15, 6) AS DOUBLE) AS temperature_c
       FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
             CASE WHEN event_id % 3 = 0 THEN 298.15 ELSE 290.0 + event_id % 20 END AS t FROM events)
       WHERE value > 0 AND k > 0""")
def ddg_from_constants(spark, sf_dir):
    temp = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise((F.lit(290) + F.col("event_id") % 20).cast("string"))
    mut, wt = F.col("value").cast("string"), F.get_json_object("props", "$.k")
    rows = table(spark, sf_dir, "events").select(
        "event_id", A.ddg(mut, wt, temp).alias("ddg"), F.round(A.celsius(temp), 6).alias("temperature_c"),
    )
    return rows.filter(F.col("ddg").isNotNull())


COMPONENTS = ["ZN", "ATP", "NAG", "GOL", "LIG", "", "HEM", "CL", "X01", "NA", "PEP", "FAD"]


@query("component_classes", "G7",
       f"""SELECT p_partkey, component,
         CASE WHEN component IN {sql_in(V.METAL_IONS)} THEN 'metal_ion' WHEN component IN {sql_in(V.COFACTORS)} THEN 'cofactor'
              WHEN component IN {sql_in(V.SUGARS)} THEN 'glycan' WHEN component IN {sql_in(V.ADDITIVES)} THEN 'additive'
              WHEN component = '' THEN 'unknown' ELSE 'small_molecule' END AS binder_type,
         CASE WHEN component IN {sql_in(V.METAL_IONS)} THEN 'structural_ion' WHEN component IN {sql_in(V.COFACTORS)} THEN 'cofactor'
              WHEN component IN {sql_in(V.SUGARS)} THEN 'unknown' WHEN component IN {sql_in(V.ADDITIVES)} THEN 'artifact'
              WHEN component = '' THEN 'unknown' ELSE 'primary_ligand' END AS role
       FROM (SELECT p_partkey, {sql_pick(COMPONENTS, 'p_partkey')} AS component FROM part)""")
def component_classes(spark, sf_dir):
    comp = pick(COMPONENTS, F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", comp.alias("component"),
                                               C.component_kind(F.lower(comp)).alias("k")).select(
        "p_partkey", "component", F.col("k.binder_type").alias("binder_type"), F.col("k.role").alias("role"))


POLYMERS = ["polypeptide(L)", "polypeptide(D)", "polyribonucleotide", "polysaccharide(D)", "other"]


@query("polymer_classes", "G7",
       f"""SELECT doc_id, CASE WHEN kind IN ('polypeptide(l)', 'polypeptide(d)') THEN
             CASE WHEN length(text) <= 30 THEN 'peptide' ELSE 'protein' END
           WHEN kind = 'polyribonucleotide' THEN 'nucleic_acid' WHEN kind = 'polysaccharide(d)' THEN 'glycan'
           ELSE 'other_polymer' END AS polymer_kind
       FROM (SELECT doc_id, text, lower({sql_pick(POLYMERS, 'doc_id')}) AS kind FROM documents)""")
def polymer_classes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", C.polymer_kind(pick(POLYMERS, F.col("doc_id")), "text").alias("polymer_kind"))


LIGANDS = ["C=CC(=O)NC1CC1", "CCO", "C1CO1C", "ClCCN", "ClC(=O)C", "CC(C)O", "C=CS(=O)C", "C[N+](C)[O-]", "C=CCCC=O"]


@query("reactive_groups", "G8",
       f"""SELECT p_partkey, ligand, ({' OR '.join("regexp_matches(ligand, '" + p + "')" for p in V.REACTIVE_GROUPS)}) AS reactive
       FROM (SELECT p_partkey, {sql_pick(LIGANDS, 'p_partkey')} || p_brand AS ligand FROM part)""")
def reactive_groups(spark, sf_dir):
    ligand = F.concat(pick(LIGANDS, F.col("p_partkey")), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", ligand.alias("ligand")).withColumn(
        "reactive", C.has_reactive_group("ligand"))


@query("ligand_input_check", "G30",
       f"""SELECT p_partkey, CASE WHEN v = '' THEN 'empty'
            WHEN NOT regexp_full_match(v, '[A-Za-z0-9@+\\-\\[\\]\\(\\)=#$:/\\\\.%,]+') THEN 'invalid_characters'
            WHEN length(replace(v, '(', '')) <> length(replace(v, ')', '')) OR position(')' IN v) BETWEEN 1 AND position('(' IN v)
                 OR length(replace(v, '[', '')) <> length(replace(v, ']', '')) THEN 'unbalanced'
            WHEN NOT regexp_matches(v, '(Cl|Br|[BCNOPSFIKH]|[cnops])') THEN 'no_atom_token' END AS problem
       FROM (SELECT p_partkey, ({sql_list(['CCO', 'C(C', ')C(', '', 'C C', '123', 'c1cc[nH]c1'])})[CAST(p_partkey % 7 AS INTEGER) + 1] AS v FROM part)""")
def ligand_input_check(spark, sf_dir):
    v = pick(["CCO", "C(C", ")C(", "", "C C", "123", "c1cc[nH]c1"], F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", T.ligand_input_error(v).alias("problem"))


@query("bracket_balance", "G30",
       r"""SELECT page_id, depth = 0 AND lowest >= 0 AS balanced FROM (
         SELECT page_id, list_reduce(list_prepend(0, steps), lambda a, b: a + b) AS depth,
                list_min(list_prepend(0, list_transform(range(1, len(steps) + 1), lambda i: list_sum(steps[1:i])))) AS lowest
         FROM (SELECT page_id, list_transform(regexp_extract_all(url || html, '[\[\]()]'),
                 lambda x: CASE WHEN x = '(' THEN 1 WHEN x = ')' THEN -1 ELSE 0 END) AS steps FROM pages))""")
def bracket_balance(spark, sf_dir):
    both = F.concat(F.col("url"), F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", T.is_balanced(both, "(", ")").alias("balanced"))


@query("text_context_flags", "G11",
       f"""SELECT doc_id, ({' OR '.join(f"contains(lower(text), '{k}')" for k in V.MEMBRANE_KEYWORDS)}) AS membrane,
         ({' OR '.join(f"contains(lower(text), '{k}')" for k in V.GLYCAN_KEYWORDS + ['the ', 'die '])}) AS glycan,
         CASE {' '.join(f"WHEN contains(lower(text), '{k}') THEN '{v}'" for k, v in V.METAL_KEYWORDS)} END AS metal,
         ({' OR '.join(f"contains(lower(text), '{k}')" for k in V.COVALENT_TITLES)}) AS covalent
       FROM documents""")
def text_context_flags(spark, sf_dir):
    low = F.lower(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", C.membrane_context("text").alias("membrane"),
        (C.glycan_context("text") | low.contains("the ") | low.contains("die ")).alias("glycan"),
        C.metal_in_text("text").alias("metal"), C.covalent_title("text").alias("covalent"))


@query("binning_ladders", "G12 G33",
       """SELECT o_orderkey,
         CASE WHEN r <= 1.5 THEN 'high_res_<=1.5' WHEN r <= 2.5 THEN 'medium_res_1.5-2.5' WHEN r <= 3.5 THEN 'low_res_2.5-3.5'
              ELSE 'very_low_res_>3.5' END AS bin,
         CASE WHEN r <= 2.0 THEN 'high_resolution' WHEN r <= 3.0 THEN 'medium_resolution' ELSE 'low_resolution' END AS bucket,
         CASE WHEN r / 6 >= 0.8 THEN 'quality_high' WHEN r / 6 >= 0.55 THEN 'quality_medium' ELSE 'quality_low' END AS band,
         CASE WHEN o_orderkey % 7 = 0 THEN '9999-12-31' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS release_day,
         o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AS in_years
       FROM (SELECT *, o_totalprice / 100000.0 AS r FROM orders)""")
def binning_ladders(spark, sf_dir):
    r = F.col("o_totalprice") / 100000.0
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", B.resolution_bin(r).alias("bin"), B.resolution_bucket(r).alias("bucket"),
        B.quality_band(r / 6).alias("band"),
        B.release_day(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate").cast("string"))).alias("release_day"),
        B.in_year_range("o_orderdate", 1994, 1996).alias("in_years"))


@query("sequence_length_bands", "G12",
       """SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'seq_unknown' WHEN length(text) < 150 THEN 'seq_short'
         WHEN length(text) < 400 THEN 'seq_medium' ELSE 'seq_long' END AS band FROM documents""")
def sequence_length_bands(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", B.sequence_length_band("text").alias("band"))


@query("task_hints", "G13",
       """SELECT p_partkey, CASE WHEN p_size % 4 >= 1 AND p_size % 3 > 0 THEN 'protein_ligand' WHEN p_size % 4 >= 2 THEN 'protein_protein'
         ELSE 'unspecified' END AS hint FROM part""")
def task_hints(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", C.task_hint(F.col("p_size") % 4, F.col("p_size") % 3).alias("hint"))


def part_objects():
    """Bound objects and interfaces of one part row, as nested lists."""
    n = F.col("p_size") % 5
    return F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(5)), lambda i: i <= n),
        lambda i: F.struct(
            pick(COMPONENTS, F.col("p_partkey") * i).alias("component"),
            C.component_kind(pick(COMPONENTS, F.col("p_partkey") * i))["binder_type"].alias("binder_type"),
            C.component_kind(pick(COMPONENTS, F.col("p_partkey") * i))["role"].alias("role"),
            F.array(pick(["A", "B", "C"], F.col("p_partkey") + i)).alias("chains"),
            ((F.col("p_partkey") + i) % 11 == 0).alias("covalent"),
        ),
    )


PART_OBJECTS_SQL = f"""
  SELECT p_partkey, p_size, i,
         {sql_pick(COMPONENTS, 'p_partkey * i')} AS component, {sql_pick(['A', 'B', 'C'], 'p_partkey + i')} AS chain,
         (p_partkey + i) % 11 = 0 AS covalent
  FROM part, (SELECT unnest(range(1, 6)) AS i) WHERE i <= p_size % 5
"""
PART_KINDS_SQL = f"""
  SELECT *, CASE WHEN component IN {sql_in(V.METAL_IONS)} THEN 'metal_ion' WHEN component IN {sql_in(V.COFACTORS)} THEN 'cofactor'
              WHEN component IN {sql_in(V.SUGARS)} THEN 'glycan' WHEN component IN {sql_in(V.ADDITIVES)} THEN 'additive'
              WHEN component = '' THEN 'unknown' ELSE 'small_molecule' END AS binder_type
  FROM ({PART_OBJECTS_SQL})
"""


@query("object_quality_flags", "G14",
       f"""WITH o AS ({PART_KINDS_SQL}), f AS (
         SELECT p_partkey, count(*) FILTER (binder_type <> 'additive') AS real_n,
           bool_or(binder_type = 'metal_ion' AND component NOT IN {sql_in(V.ALKALI_IONS)}) AS free_metal,
           bool_or(binder_type = 'cofactor' AND component IN {sql_in(V.METALLO_COFACTORS)}) AS metal_cof,
           bool_or(binder_type = 'cofactor') AS cof, bool_or(binder_type = 'glycan') AS gly, bool_or(covalent) AS cov,
           bool_or(binder_type = 'additive') AS art FROM o GROUP BY p_partkey)
       SELECT p.p_partkey, concat_ws(';',
         CASE WHEN p_size > 45 THEN 'very_low_resolution' WHEN p_size > 35 THEN 'low_resolution' END,
         CASE WHEN p_partkey % 4 = 0 THEN 'no_experimental_method' END,
         CASE WHEN p_partkey % 3 = 0 THEN 'missing_ligand_id' END,
         CASE WHEN p_size % 3 >= 2 THEN 'multimeric_complex' END,
         CASE WHEN real_n > 1 THEN 'multiple_bound_objects' END,
         CASE WHEN free_metal OR metal_cof THEN 'metal_present' END,
         CASE WHEN free_metal AND real_n > 0 THEN 'metal_mediated_binding_possible' END,
         CASE WHEN cof THEN 'cofactor_present' END, CASE WHEN gly THEN 'glycan_present' END,
         CASE WHEN cov THEN 'covalent_binder' END, CASE WHEN art THEN 'possible_crystallization_additive' END,
         CASE WHEN p_size % 7 > 1 THEN 'assembly_ambiguity' END) AS flags
       FROM part p LEFT JOIN f USING (p_partkey)""")
def object_quality_flags(spark, sf_dir):
    res = F.col("p_size") / 10.0
    some = F.array(F.lit("x"))
    flags = Q.scalar_flags(res, F.when(F.col("p_partkey") % 4 != 0, "x"), F.lit("s"), F.lit("s"),
                           F.lit("protein_ligand"), some, some, F.when(F.col("p_partkey") % 3 != 0, "L"))
    none = F.filter(F.array(F.struct(F.lit(False).alias("is_symmetric"), F.lit(False).alias("is_hetero"))),
                    lambda i: i["is_hetero"])
    flags += Q.object_flags(F.col("objects"), none, F.col("p_size") % 3 + 1, F.col("p_size") % 7, F.lit(False))
    return table(spark, sf_dir, "part").withColumn("objects", part_objects()).select(
        "p_partkey", F.array_join(Q.named(flags), ";").alias("flags"))


@query("record_quality_scores", "G15",
       """SELECT d.doc_id, round((1.0 + CAST(n_chars <= 3500 AS INT) + 1 + CAST(lang <> 'de' AS INT) + 1
           + CAST(source <> 'src1' AS INT) + CAST(doc_id % 2 = 1 OR doc_id % 3 <> 0 AS INT) + 1) / 8.0, 4) AS sample_score,
         CASE WHEN doc_id % 5 = 0 THEN round(greatest(0.0, least(1.0, n_chars / 3000.0)), 4)
              WHEN CAST(n_chars <= 3500 AS INT) + CAST(lang = 'en' AS INT) = 0 THEN NULL
              ELSE round((CAST(n_chars <= 3500 AS INT) + CAST(lang = 'en' AS INT)) / 2.0, 4) END AS entry_score
       FROM documents d""")
def record_quality_scores(spark, sf_dir):
    n = F.col("doc_id")
    res = F.col("n_chars") / 1000.0
    task = F.when(n % 2 == 0, "protein_ligand").otherwise("mutation_ddg")
    score = Q.sample_score(
        res, F.col("lang"), F.col("text"), F.lit(None), task,
        F.filter(F.array("lang"), lambda x: x != "de"), F.array("lang"),
        F.filter(F.array("source"), lambda x: x != "src1"), F.when(n % 3 != 0, "L"))
    explicit = F.when(n % 5 == 0, F.col("n_chars") / 3000.0)
    return table(spark, sf_dir, "documents").select(
        "doc_id", score.alias("sample_score"),
        Q.entry_score(explicit, [res <= 3.5, F.col("lang") == "en"]).alias("entry_score"))


@query("confidence_penalties", "G16",
       """SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.2
         ELSE round(CASE WHEN o_orderstatus = 'O' THEN 0.08 WHEN o_orderstatus = 'F' THEN 0.16 ELSE 0 END
            + CASE WHEN o_orderpriority LIKE '1%' THEN 0.16 ELSE 0 END, 6) END AS DOUBLE) AS penalty FROM orders""")
def confidence_penalties(spark, sf_dir):
    level = F.when(F.col("o_orderstatus") == "O", "medium").when(F.col("o_orderstatus") == "F", "LOW").otherwise("high")
    raw = F.to_json(F.create_map(F.lit("a"), level, F.lit("b"),
                                 F.when(F.col("o_orderpriority").startswith("1"), "low").otherwise("high")))
    n = F.col("o_orderkey") % 4
    text = F.when(n == 0, "").when(n == 1, F.concat(F.lit("{"), raw)).otherwise(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(Q.confidence_penalty(text), 6).alias("penalty"))


@query("delimited_lists", "G19",
       r"""SELECT doc_id, len(v) AS n_values, md5(array_to_string(v, '|')) AS values_md5 FROM (
         SELECT doc_id, list_filter(list_transform(list_sort(list_distinct(list_transform(
             range(1, len(parts) + 1), lambda i: printf('%09d', list_position(parts, parts[i])) ))), lambda k: parts[CAST(k AS INTEGER)]), lambda x: x <> '') AS v
         FROM (SELECT doc_id, list_transform(regexp_split_to_array(replace(text, chr(10), ' '), '[;,]'), lambda x: trim(x)) AS parts FROM documents))""")
def delimited_lists(spark, sf_dir):
    flat = F.translate("text", "\n", " ")
    return table(spark, sf_dir, "documents").select("doc_id", T.distinct_parts(flat).alias("v")).select(
        "doc_id", F.size("v").cast("bigint").alias("n_values"), F.md5(F.array_join("v", "|")).alias("values_md5"))


@query("safe_casts", "G20",
       """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE k END AS as_double,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(trunc(k) AS BIGINT) END AS as_int,
         CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN NULL ELSE true END AS as_bool
       FROM (SELECT event_id, value AS k FROM events)""")
def safe_casts(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    flag = pick([" TRUE", "no", "maybe", "1"], F.col("event_id"))
    return table(spark, sf_dir, "events").select(
        "event_id", T.safe_double(raw).alias("as_double"), T.safe_int(raw).alias("as_int"),
        T.safe_bool(flag).alias("as_bool"))


@query("hashed_text_features", "G22",
       """WITH t AS (SELECT item_id, trim(text, ' ') AS v FROM benchmark),
       g AS (SELECT item_id, substr(v, i, n) AS tok FROM t, (SELECT unnest([2, 3]) AS n), LATERAL (SELECT unnest(range(1, length(v) - n + 2)) AS i)),
       b AS (SELECT item_id, 'lig.hash_' || lpad(CAST(CAST('0x' || substr(md5('lig:' || tok), 1, 8) AS BIGINT) % 32 AS VARCHAR), 2, '0') AS bucket FROM g)
       SELECT item_id, bucket, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY item_id) AS DOUBLE), 6) AS share
       FROM b GROUP BY item_id, bucket""")
def hashed_text_features(spark, sf_dir):
    from affinityloom.operators.features import hashed_feature_rows
    return hashed_feature_rows(table(spark, sf_dir, "benchmark"), "item_id", "text", "lig", 32, (2, 3))


@query("hashed_whole_values", "G22",
       """SELECT doc_id, 'source.hash_' || lpad(CAST(CAST('0x' || substr(md5('source:' || source), 1, 8) AS BIGINT) % 16 AS VARCHAR), 2, '0') AS bucket
       FROM documents""")
def hashed_whole_values(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.element_at(H.hashed_tokens("source", "source", 16), 1).alias("bucket"))


@query("sequence_embeddings", "G21",
       f"""WITH s AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS q FROM documents),
       k AS (SELECT doc_id, CAST('0x' || substr(md5(substr(q, i, 3)), 1, 2) AS INT) % 12 AS bin
             FROM s, LATERAL (SELECT unnest(range(1, length(q) - 1)) AS i)),
       b AS (SELECT doc_id, bin, count(*) AS c FROM k GROUP BY 1, 2),
       t AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS total FROM b GROUP BY 1)
       SELECT s.doc_id AS doc_id, round((length(q) - length(replace(q, 'A', ''))) / greatest(length(q), 1), 6) AS share_a,
         round((length(q) - length(replace(q, 'Y', ''))) / greatest(length(q), 1), 6) AS share_y,
         round(coalesce((SELECT c FROM b WHERE b.doc_id = s.doc_id AND bin = 0), 0) / coalesce(t.total, 1), 6) AS bin_0,
         round(coalesce((SELECT c FROM b WHERE b.doc_id = s.doc_id AND bin = 11), 0) / coalesce(t.total, 1), 6) AS bin_11
       FROM s LEFT JOIN t USING (doc_id)""")
def sequence_embeddings(spark, sf_dir):
    from affinityloom.operators.features import sequence_embedding
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    e = sequence_embedding(table(spark, sf_dir, "documents").select("doc_id", letters.alias("q")), "doc_id", "q")
    return e.select(
        "doc_id", F.round(F.col("embedding")[0], 6).alias("share_a"), F.round(F.col("embedding")[19], 6).alias("share_y"),
        F.round(F.col("embedding")[20], 6).alias("bin_0"), F.round(F.col("embedding")[31], 6).alias("bin_11"))


@query("metadata_embeddings", "G21",
       f"""SELECT doc_id, {', '.join(f"round((CAST(a = {b} AS INT) + CAST(c = {b} AS INT)) / 2.0, 6) AS bin_{b}" for b in range(8))}
       FROM (SELECT doc_id, CAST('0x' || substr(md5(lang), 1, 2) AS INT) % 8 AS a,
                    CAST('0x' || substr(md5(source), 1, 2) AS INT) % 8 AS c FROM documents)""")
def metadata_embeddings(spark, sf_dir):
    e = H.metadata_embedding([F.col("lang"), F.upper("source"), F.lit("")])
    return table(spark, sf_dir, "documents").select("doc_id", e.alias("e")).select(
        "doc_id", *[F.round(F.col("e")[b], 6).alias(f"bin_{b}") for b in range(8)])


@query("numeric_flatten", "G23",
       """SELECT event_id, 'outer.k' AS feature, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events
       UNION ALL SELECT event_id, 'outer.inner.value', value FROM events
       UNION ALL SELECT event_id, 'outer.inner.flag', CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END FROM events""")
def numeric_flatten(spark, sf_dir):
    from affinityloom.operators.features import numeric_feature_rows
    nested = table(spark, sf_dir, "events").select(
        "event_id", F.struct(
            F.get_json_object("props", "$.k").cast("double").alias("k"),
            F.struct("value", (F.col("event_type") == "view").alias("flag"), F.col("event_type").alias("note")).alias("inner"),
        ).alias("outer"))
    return numeric_feature_rows(nested, "event_id", ["outer"])


@query("affinity_scores", "G24",
       """SELECT event_id, round(greatest(0.0, least(1.0, 1.0 - l / 6.0)), 6) AS strength,
         round(CASE event_type WHEN 'view' THEN 0.2 WHEN 'click' THEN 0.1 WHEN 'error' THEN -0.05 ELSE 0.0 END
               - CASE WHEN event_id % 2 = 0 THEN 0.1 ELSE 0 END, 6)::DOUBLE AS bonus,
         round(1.0 / (1.0 + exp(-l)), 6) AS confidence,
         CASE WHEN value * 1000 <= 1000 THEN 'strong_binder_predicted' WHEN value * 1000 <= 10000 THEN 'binder_predicted'
              WHEN value * 1000 <= 100000 THEN 'weak_binder_predicted' ELSE 'unlikely_binder' END AS call,
         round(-1.364 * l, 3) + 0.0::DOUBLE AS free_energy
       FROM (SELECT *, log10(value) AS l FROM events WHERE value > 0)""")
def affinity_scores(spark, sf_dir):
    band = F.when(F.col("event_type") == "view", "High").when(F.col("event_type") == "click", "medium") \
        .when(F.col("event_type") == "error", "low")
    return table(spark, sf_dir, "events").filter("value > 0").withColumn("l", F.log10("value")).select(
        "event_id", F.round(A.strength("l"), 6).alias("strength"),
        F.round(A.confidence_bonus(band, F.col("event_id") % 2 == 0), 6).alias("bonus"),
        F.round(A.logistic("l"), 6).alias("confidence"), A.binding_call(F.col("value") * 1000).alias("call"),
        A.free_energy_proxy("l").alias("free_energy"))


@query("context_alignment", "G25",
       """SELECT o_orderkey, round((greatest(0.0, 1 - abs(o_custkey - 500.0) / greatest(abs(o_custkey), 500.0, 1.0))
          + CASE WHEN o_orderkey % 2 = 0 THEN greatest(0.0, 1 - abs(o_totalprice - 150000.0) / greatest(abs(o_totalprice), 150000.0, 1.0)) ELSE 0 END)
          / CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END, 4) AS alignment FROM orders""")
def context_alignment(spark, sf_dir):
    q = F.map_filter(
        F.create_map(F.lit("cust"), F.col("o_custkey").cast("double"), F.lit("only_query"), F.lit(1.0), F.lit("price"),
                     F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))), lambda k, v: v.isNotNull())
    p = F.create_map(F.lit("cust"), F.lit(500.0), F.lit("price"), F.lit(150000.0), F.lit("only_profile"), F.lit(2.0))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.context_alignment(q, p).alias("alignment"))


RESIDUE_CYCLE = ["ASP", "GLU", "LYS", "ARG", "HIS", "CYS", "TYR", "ALA"]


@query("site_motifs", "G27",
       f"""SELECT l_orderkey, l_linenumber, CASE WHEN atom = 'O' THEN 'backbone_carbonyl_oxygen' WHEN atom = 'N' THEN 'backbone_amide_nitrogen'
           {' '.join(f"WHEN res = '{r}' AND atom = '{a}' THEN '{m}'" for (r, a), m in S.SITE_MOTIFS.items())} END AS motif,
         CAST(CASE WHEN res IN ('ASP', 'GLU') AND left(atom, 1) = 'O' THEN -0.5 WHEN res IN ('ARG', 'HIS', 'LYS') AND left(atom, 1) = 'N' THEN 0.5
              ELSE 0.0 END AS DOUBLE) AS charge_proxy
       FROM (SELECT l_orderkey, l_linenumber, {sql_pick(RESIDUE_CYCLE, 'l_partkey')} AS res,
             {sql_pick(['O', 'N', 'OD1', 'OE1', 'NZ', 'NH1', 'ND1', 'SG', 'OH', 'CA'], 'l_suppkey + l_linenumber')} AS atom FROM lineitem)""")
def site_motifs(spark, sf_dir):
    res = pick(RESIDUE_CYCLE, F.col("l_partkey"))
    atom = pick(["O", "N", "OD1", "OE1", "NZ", "NH1", "ND1", "SG", "OH", "CA"], F.col("l_suppkey") + F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", S.protein_site_motif(res, atom).alias("motif"),
        S.charge_proxy(F.substring(atom, 1, 1), res).alias("charge_proxy"))


@query("microstate_ladder", "G28",
       f"""SELECT o_orderkey, CAST(CASE WHEN r IN ('ASP', 'GLU') THEN round(greatest(-1.0, least(0.0, -1.0
             + CASE WHEN s < 4.0 THEN 0.35 ELSE 0 END - CASE WHEN o < 4.5 THEN 0.20 ELSE 0 END - CASE WHEN m < 3.2 THEN 0.25 ELSE 0 END)), 4)
           WHEN r IN ('LYS', 'ARG') THEN round(greatest(0.0, least(1.0, 1.0 - CASE WHEN s < 4.0 THEN 0.25 ELSE 0 END
             + CASE WHEN o < 4.5 THEN 0.10 ELSE 0 END)), 4)
           WHEN r = 'HIS' THEN CASE WHEN m < 3.2 THEN 0.7 WHEN o < 4.0 THEN 0.5 WHEN s < 4.0 THEN 0.1 ELSE 0.0 END
           WHEN r IN ('CYS', 'TYR') THEN CASE WHEN m < 3.0 THEN -0.4 WHEN o < 4.0 THEN -0.2 ELSE 0.0 END ELSE 0.0 END AS DOUBLE) AS charge,
         CASE WHEN r IN ('ASP', 'GLU', 'HIS') AND (s IS NOT NULL OR o IS NOT NULL OR m IS NOT NULL) THEN 'medium'
              WHEN r IN ('LYS', 'ARG') AND (s IS NOT NULL OR o IS NOT NULL) THEN 'medium' ELSE 'low' END AS confidence
       FROM (SELECT o_orderkey, {sql_pick(RESIDUE_CYCLE, 'o_orderkey')} AS r,
             CASE WHEN o_custkey % 3 > 0 THEN 2.0 + (o_custkey % 9) * 0.5 END AS s,
             CASE WHEN o_custkey % 4 > 0 THEN 2.0 + (o_custkey % 7) * 0.5 END AS o,
             CASE WHEN o_custkey % 5 > 2 THEN 2.0 + (o_custkey % 5) * 0.5 END AS m FROM orders)""")
def microstate_ladder(spark, sf_dir):
    c = F.col("o_custkey")
    same = F.when(c % 3 > 0, 2.0 + (c % 9) * 0.5)
    opp = F.when(c % 4 > 0, 2.0 + (c % 7) * 0.5)
    metal = F.when(c % 5 > 2, 2.0 + (c % 5) * 0.5)
    return table(spark, sf_dir, "orders").withColumn(
        "m", S.microstate(pick(RESIDUE_CYCLE, F.col("o_orderkey")), same, opp, metal)
    ).select("o_orderkey", F.col("m.adjusted_charge").alias("charge"), F.col("m.confidence").alias("confidence"))


@query("descriptor_distances", "G29",
       """SELECT vec_id, round(list_sum(list_transform(range(1, len(v)), lambda i: abs(v[i] - v[i + 1]) / greatest(abs(v[i]), abs(v[i + 1]), 1.0)))
          / (len(v) - 1), 6) AS shift_distance, sha256(array_to_string(list_transform(v[1:4], lambda x: CAST(CAST(round(x * 1000) AS BIGINT) AS VARCHAR)), ',')) AS archetype_hash
       FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)""")
def descriptor_distances(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    head = F.transform(F.slice(v, 1, 4), lambda x: F.round(x * 1000).cast("bigint").cast("string"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.round(S.descriptor_distance(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1)), 6).alias("shift_distance"),
        F.sha2(F.array_join(head, ","), 256).alias("archetype_hash"))


@query("oligomeric_states", "G10",
       """SELECT p_partkey, CASE WHEN n = 0 THEN 'no_protein' WHEN n = 1 AND c <= 1 THEN 'monomer' WHEN n = 1 AND c = 2 THEN 'homodimer'
          WHEN n = 1 AND c = 3 THEN 'homotrimer' WHEN n = 1 AND c = 4 THEN 'homotetramer' WHEN n = 1 THEN 'homo_' || c || 'mer'
          WHEN n = 2 AND c = 1 THEN 'heterodimer' ELSE 'hetero_complex_' || n || '_entities' END AS state
       FROM (SELECT p_partkey, p_size % 4 AS n, p_partkey % 6 AS c FROM part)""")
def oligomeric_states(spark, sf_dir):
    chains = F.filter(F.array(*[F.lit(x) for x in "ABCDE"]), lambda x, i: i < F.col("p_partkey") % 6)
    proteins = F.filter(F.array(chains, chains, chains), lambda x, i: i < F.col("p_size") % 4)
    return table(spark, sf_dir, "part").select("p_partkey", C.oligomeric_state(proteins).alias("state"))


@query("interface_pairs", "G9",
       """WITH e AS (SELECT p_partkey, p_size % 4 AS n, p_partkey % 2 AS q, p_partkey % 3 + 1 AS c FROM part),
       f AS (SELECT p_partkey, 'E1' AS a, 'E1' AS b, 'protein_protein' AS kind, true AS is_symmetric FROM e WHERE n = 1 AND c >= 2
         UNION ALL SELECT p_partkey, 'E' || i, 'E' || j, 'protein_protein', false FROM e, (SELECT unnest([1, 1, 2]) AS i, unnest([2, 3, 3]) AS j)
           WHERE n >= 2 AND j <= n
         UNION ALL SELECT p_partkey, 'E1', 'Q1', 'protein_peptide', false FROM e WHERE n >= 1 AND q = 1)
       SELECT p_partkey, a, b, kind, is_symmetric FROM f""")
def interface_pairs(spark, sf_dir):
    chains = F.filter(F.array(*[F.lit(x) for x in "ABC"]), lambda x, i: i < F.col("p_partkey") % 3 + 1)
    entity = lambda name: F.struct(F.lit(name).alias("entity"), chains.alias("chains"))
    proteins = F.filter(F.array(entity("E1"), entity("E2"), entity("E3")), lambda x, i: i < F.col("p_size") % 4)
    peptides = F.filter(F.array(entity("Q1")), lambda x, i: i < F.col("p_partkey") % 2)
    return (table(spark, sf_dir, "part").select("p_partkey", F.explode(C.interface_pairs(proteins, peptides)).alias("f"))
            .select("p_partkey", F.col("f.entity_a").alias("a"), F.col("f.entity_b").alias("b"),
                    F.col("f.interface_type").alias("kind"), F.col("f.is_symmetric").alias("is_symmetric")))


@query("role_disambiguation", "E5",
       f"""WITH o AS ({PART_KINDS_SQL}),
       s AS (SELECT p_partkey, min(i) FILTER (binder_type = 'small_molecule') AS first_small,
                    list(chain) FILTER (binder_type = 'small_molecule') AS lig_chains FROM o GROUP BY p_partkey)
       SELECT o.p_partkey, o.i AS object_number, CASE WHEN binder_type = 'small_molecule' AND o.i > first_small THEN 'co_ligand'
         WHEN binder_type = 'metal_ion' AND list_contains(lig_chains, chain) THEN 'metal_mediated_contact'
         WHEN binder_type = 'metal_ion' THEN 'structural_ion' WHEN binder_type = 'cofactor' THEN 'cofactor'
         WHEN binder_type = 'additive' THEN 'artifact' WHEN binder_type = 'small_molecule' THEN 'primary_ligand' ELSE 'unknown' END AS role
       FROM o JOIN s USING (p_partkey)""")
def role_disambiguation(spark, sf_dir):
    return (table(spark, sf_dir, "part").select("p_partkey", F.posexplode(C.disambiguated_roles(part_objects())))
            .select("p_partkey", (F.col("pos") + 1).cast("bigint").alias("object_number"), F.col("col.role").alias("role")))


@query("context_recovered_objects", "G11 F6",
       f"""WITH o AS ({PART_KINDS_SQL}), h AS (SELECT p_partkey, bool_or(binder_type = 'glycan') AS g, bool_or(binder_type = 'metal_ion') AS m FROM o GROUP BY p_partkey)
       SELECT p_partkey, p_size % 5 + CASE WHEN NOT coalesce(g, false) AND p_partkey % 3 = 0 THEN 1 ELSE 0 END
         + CASE WHEN NOT coalesce(m, false) AND p_partkey % 2 = 0 THEN 1 ELSE 0 END AS n_objects FROM part LEFT JOIN h USING (p_partkey)""")
def context_recovered_objects(spark, sf_dir):
    title = F.concat(F.when(F.col("p_partkey") % 3 == 0, "Glycosylated form ").otherwise("Form "),
                     F.when(F.col("p_partkey") % 2 == 0, "with Zinc").otherwise("apo"))
    plain = F.transform(part_objects(), lambda o: F.struct(
        o["component"].alias("component"), o["binder_type"].alias("binder_type"), o["role"].alias("role"), o["chains"].alias("chains")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.size(C.missing_context_objects(plain, title)).cast("int").alias("n_objects"))


@query("conformation_states", "G31",
       """SELECT 'S' || s_suppkey || ':experimental' AS state_id, CASE WHEN s_suppkey % 3 > 0 THEN 'U' || s_nationkey ELSE 'S' || s_suppkey END AS target_id,
         CASE WHEN s_suppkey % 2 = 0 THEN 'holo' END AS apo_or_holo, 'experimental_observed' AS conformation FROM supplier
       UNION ALL SELECT 'U' || s_nationkey || ':alphafold_planned', 'U' || s_nationkey, 'apo_like', 'predicted_pending' FROM supplier WHERE s_suppkey % 3 > 0""")
def conformation_states(spark, sf_dir):
    from affinityloom.operators.features import conformation_rows
    entries = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("entry_id"),
        F.when(F.col("s_suppkey") % 2 == 0, "protein_ligand").otherwise("").alias("task_hint"),
        F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("U"), F.col("s_nationkey").cast("string"))).alias("accession"))
    return conformation_rows(entries).select("state_id", "target_id", "apo_or_holo", "conformation")
