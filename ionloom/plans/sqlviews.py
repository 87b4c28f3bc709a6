"""The derivations of ``sources.derived`` in DuckDB SQL, for the oracle queries."""

SPECTRA = """
spectra AS (
  SELECT o_orderkey AS sid, o_orderpriority AS file,
         (date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 600) / 10.0 AS rt,
         round(900.0 + o_totalprice % 100.0, 2) AS precursor_mz
  FROM orders)"""

PEAKS = """
peaks AS (
  SELECT l_orderkey AS sid, l_linenumber AS scan_no, l_extendedprice AS mz, l_quantity AS intensity
  FROM lineitem)"""

LIBRARY = """
library AS (SELECT p_partkey AS lid, p_name AS name, p_retailprice AS lib_mz FROM part)"""

FRAGMENTS = """
fragments AS (
  SELECT l_partkey AS lid, l_extendedprice AS frag_mz, l_quantity AS intensity FROM lineitem)"""

LIPIDS = """
numbered AS (
  SELECT *, l_orderkey * 2 + l_partkey % 2 AS q FROM lineitem),
chains AS (
  SELECT *, 14 + q % 5 AS c1, q % 3 AS u1, 16 + (q // 7) % 6 AS c2, (q // 5) % 2 AS u2,
         ['PC', 'PE', 'TG', 'Cer', 'PI', 'SM'][q % 6 + 1] AS lipid_class,
         ['[M+H]+', '[M+CH3COO]-', '[M+HCOO]-', '[M-H]-'][(q // 3) % 4 + 1] AS add_text
  FROM numbered),
spelled AS (
  SELECT *, lipid_class || ' ' || c1 || ':' || u1 || CASE WHEN lipid_class = 'Cer' THEN ';O2' ELSE '' END
            || '_' || c2 || ':' || u2 AS lipid_name,
         'C' || (c1 + c2 + 8) || 'H' || ((c1 + c2) * 2 - (u1 + u2) * 2 + 16) || 'NO' || (6 + q % 4) || 'P' AS lipid_formula
  FROM chains),
lipids AS (
  SELECT q, 'run_' || (l_orderkey % 3) AS file, l_orderkey AS peak_num,
         round(500.0 + CAST(l_orderkey % 1000 AS DOUBLE) / 10.0, 1) AS mz,
         round(2.0::DOUBLE + (c1 + c2 - 30) * 0.6::DOUBLE + CAST(l_orderkey % 4 AS DOUBLE) / 4.0, 2) AS rt,
         'LEVEL' || (1 + l_linenumber % 4) || '_DES_' || lipid_name || '-Fomula-' || lipid_formula
           || '-CCS-' || (q % 9) || '-Add-' || add_text AS title,
         round(0.4::DOUBLE + l_discount * 6, 2) AS score1, round(l_tax * 10, 1) AS score2,
         l_linenumber AS line, l_extendedprice AS price, l_quantity AS quantity,
         lipid_name, lipid_formula, add_text, lipid_class, c1, c2, u1, u2
  FROM spelled)"""

ANNOTATIONS = LIPIDS + """,
annotations AS (
  SELECT q AS x, file, peak_num, mz, rt, max(score1) AS score_match, max(score2) AS score_ratio,
         lipid_name AS title, lipid_formula AS formula, add_text AS adduct, lipid_class AS subclass,
         CAST(c1 + c2 AS DOUBLE) AS total_c,
         (u1 + u2) || ';' || CASE WHEN lipid_class = 'Cer' THEN 'O2' ELSE '' END AS total_uns,
         (c1 + c2 + 8) * 12.0::DOUBLE + ((c1 + c2) * 2 - (u1 + u2) * 2 + 16) * 1.007825032::DOUBLE + 14.003074004::DOUBLE
           + (6 + q % 4) * 15.99491462::DOUBLE + 30.973761998::DOUBLE AS rawmz
  FROM lipids GROUP BY ALL)"""
