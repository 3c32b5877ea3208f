"""The registered queries in plain SQL, built from named common table expressions."""

from __future__ import annotations

import re

# name -> SQL of one table expression; each may use the ones above it.
_TABLES: dict[str, str] = {
    "base": """
        SELECT l_orderkey, l_linenumber, cast(l_orderkey AS VARCHAR) AS ID_SCONTRINO, o_custkey AS ID_CLI,
               l_suppkey AS ID_NEG, l_partkey AS ID_ARTICOLO, cast(substr(p_brand, 7) AS INTEGER) AS COD_REPARTO,
               CASE WHEN l_returnflag = 'R' AND l_linenumber IN (2, 4) THEN -1 ELSE 1 END AS DIREZIONE,
               cast(l_extendedprice AS DECIMAL(18,2)) AS gross, cast(l_discount AS DECIMAL(4,2)) AS rate,
               o_orderdate + to_hours(cast(l_orderkey % 13 + 8 AS INTEGER))
                           + to_minutes(cast(l_orderkey * 7 % 60 AS INTEGER)) AS DATETIME
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "priced": """
        SELECT *, cast(round(CASE WHEN l_linenumber = 7 AND rate >= 0.09 THEN gross * cast(1.1 AS DECIMAL(4,2))
                                  WHEN l_linenumber = 7 AND rate = 0.08 THEN gross
                                  ELSE gross * rate END, 2) AS DECIMAL(18,2)) AS SCONTO
        FROM base""",
    "transactions": """
        SELECT ID_SCONTRINO, ID_CLI, ID_NEG, ID_ARTICOLO, COD_REPARTO, DIREZIONE, gross AS IMPORTO_LORDO, SCONTO,
               DATETIME FROM priced
        UNION ALL
        SELECT ID_SCONTRINO, ID_CLI, ID_NEG, ID_ARTICOLO, COD_REPARTO, DIREZIONE, gross, SCONTO, DATETIME
        FROM priced WHERE l_orderkey % 50 = 0
        UNION ALL
        SELECT ID_SCONTRINO, ID_CLI, ID_NEG, ID_ARTICOLO, COD_REPARTO, DIREZIONE,
               cast(gross + 1 AS DECIMAL(18,2)), SCONTO, DATETIME
        FROM priced WHERE l_orderkey % 97 = 0 AND l_linenumber = 1""",
    "raw_transactions": """
        SELECT ID_SCONTRINO, ID_CLI, ID_NEG, ID_ARTICOLO, COD_REPARTO, DIREZIONE,
               replace(cast(IMPORTO_LORDO AS VARCHAR), '.', ',') AS IMPORTO_LORDO,
               replace(cast(SCONTO AS VARCHAR), '.', ',') AS SCONTO,
               strftime(DATETIME, '%Y-%m-%d %H:%M:%S') AS DATETIME
        FROM transactions""",
    "net": """
        SELECT *, cast(IMPORTO_LORDO - SCONTO AS DECIMAL(18,2)) AS IMPORTO_NETTO FROM transactions
        WHERE IMPORTO_LORDO - SCONTO IS NULL OR IMPORTO_LORDO - SCONTO >= 0""",
    "copies": """
        SELECT *, count(*) OVER (PARTITION BY ID_SCONTRINO, ID_CLI, ID_NEG, ID_ARTICOLO, COD_REPARTO, DIREZIONE,
                                 DATETIME, IMPORTO_LORDO, SCONTO) AS n_full
        FROM net""",
    "conflicts": """
        SELECT *, sum(CASE WHEN n_full = 1 THEN 1 ELSE 0 END) OVER (
            PARTITION BY ID_SCONTRINO, ID_CLI, ID_NEG, ID_ARTICOLO, COD_REPARTO, DIREZIONE, DATETIME) AS n_lone
        FROM copies""",
    "lines": """
        SELECT ID_SCONTRINO, ID_CLI, ID_NEG, ID_ARTICOLO, COD_REPARTO, DIREZIONE, DATETIME, IMPORTO_LORDO, SCONTO,
               IMPORTO_NETTO, cast(hour(DATETIME) AS INTEGER) AS ORA, cast(DATETIME AS DATE) AS DATA
        FROM conflicts WHERE n_full > 1 OR n_lone = 1""",
    "cutoff": "SELECT cast(max(DATA) - 365 AS DATE) AS day FROM lines",
    "loyalty": """
        SELECT CASE WHEN o_custkey % 13 = 0 THEN -o_custkey ELSE o_custkey END AS ID_CLI, o_orderkey AS ID_FID,
               o_orderkey % 100 AS ID_NEG, o_orderpriority AS COD_FID,
               o_orderkey % 3 AS TYP_CLI_FID, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS STATUS_FID,
               cast(date_trunc('year', o_orderdate) AS TIMESTAMP) AS DT_ACTIVE
        FROM orders""",
    "accounts": """
        SELECT c_custkey AS ID_CLI,
               CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'prov_' || c_nationkey END AS EMAIL_PROVIDER,
               CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 1 END AS W_PHONE, c_custkey AS ID_ADDRESS,
               c_custkey % 4 AS TYP_CLI_ACCOUNT,
               CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS TYP_JOB
        FROM customer""",
    "addresses": """
        SELECT CASE WHEN c_custkey % 10 = 0 THEN -c_custkey ELSE c_custkey END AS ID_ADDRESS,
               CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE cast(20100 + c_nationkey AS VARCHAR) END AS CAP
        FROM customer CROSS JOIN (VALUES (0), (1)) AS copies(copy)
        WHERE copy = 0 OR c_custkey % 5 = 0""",
    "privacy": """
        SELECT c_custkey AS ID_CLI, c_custkey % 2 AS FLAG_PRIVACY_1,
               CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS FLAG_PRIVACY_2,
               CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS FLAG_DIRECT_MKT
        FROM customer""",
    "clean_addresses": "SELECT DISTINCT ID_ADDRESS, CAP FROM addresses WHERE ID_ADDRESS IS NOT NULL AND CAP IS NOT NULL",
    "filled_accounts": """
        SELECT ID_CLI, coalesce(EMAIL_PROVIDER, '(missing)') AS EMAIL_PROVIDER, coalesce(W_PHONE, 0) AS W_PHONE,
               ID_ADDRESS, TYP_CLI_ACCOUNT, coalesce(TYP_JOB, '(missing)') AS TYP_JOB
        FROM accounts""",
    "top_providers": """
        SELECT EMAIL_PROVIDER AS kept FROM filled_accounts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20""",
    "clean_accounts": """
        SELECT ID_CLI, coalesce(kept, 'other') AS EMAIL_PROVIDER, W_PHONE, ID_ADDRESS, TYP_CLI_ACCOUNT, TYP_JOB
        FROM filled_accounts LEFT JOIN top_providers ON EMAIL_PROVIDER = kept""",
    "ranked_cards": """
        SELECT *, row_number() OVER (PARTITION BY ID_CLI ORDER BY DT_ACTIVE, ID_FID) AS from_first,
               row_number() OVER (PARTITION BY ID_CLI ORDER BY DT_ACTIVE DESC, ID_FID DESC) AS from_last
        FROM loyalty""",
    "card_counts": """
        SELECT ID_CLI, count(DISTINCT ID_FID) AS NUM_FIDs, count(DISTINCT DT_ACTIVE) AS NUM_DATEs
        FROM loyalty GROUP BY 1""",
    "clean_loyalty": """
        SELECT l.ID_CLI, l.ID_FID, l.COD_FID AS LAST_COD_FID, l.TYP_CLI_FID AS LAST_TYP_CLI_FID,
               l.STATUS_FID AS LAST_STATUS_FID, l.DT_ACTIVE AS LAST_DT_ACTIVE, f.ID_NEG AS FIRST_ID_NEG,
               f.DT_ACTIVE AS FIRST_DT_ACTIVE, c.NUM_FIDs
        FROM ranked_cards l JOIN ranked_cards f ON l.ID_CLI = f.ID_CLI AND f.from_first = 1
        JOIN card_counts c ON l.ID_CLI = c.ID_CLI
        WHERE l.from_last = 1""",
    "days": """
        SELECT ID_CLI, DATA, row_number() OVER (PARTITION BY ID_CLI ORDER BY DATA DESC) AS back
        FROM (SELECT DISTINCT ID_CLI, DATA FROM lines)""",
    "gaps": """
        SELECT ID_CLI, min(DATA) AS PRIMO_ACQUISTO, max(DATA) AS ULTIMO_ACQUISTO, count(*) AS NUMERO_ACQUISTI,
               max(CASE WHEN back = 2 THEN DATA END) AS PENULTIMO_ACQUISTO,
               coalesce(max(DATA) - max(CASE WHEN back = 2 THEN DATA END), 0) AS NEXT_PURCHASE_DAY
        FROM days GROUP BY 1""",
    "labelled": """
        SELECT ID_CLI, max(DATA) AS LAST_PURCHASE_DATE, sum(IMPORTO_LORDO) AS TOTAL_PURCHASE, count(*) AS N_LINES,
               count(DISTINCT CASE WHEN DIREZIONE <> -1 THEN ID_SCONTRINO END) AS NUMBER_OF_PURCHASE,
               CASE WHEN max(DATA) < (SELECT day FROM cutoff) THEN 1 ELSE 0 END AS CHURN
        FROM lines GROUP BY 1""",
    "receipts": """
        SELECT ID_CLI, count(DISTINCT ID_SCONTRINO) AS TOT_SCONTRINI FROM lines WHERE DIREZIONE <> -1 GROUP BY 1""",
    "active": "SELECT * FROM lines WHERE DATETIME > cast((SELECT day FROM cutoff) AS TIMESTAMP)",
    "rfm": """
        SELECT ID_CLI,
               cast(floor(epoch((SELECT max(DATETIME) FROM active) - max(DATETIME)) / 86400) AS INTEGER) AS Recency,
               count(*) AS Frequency, sum(IMPORTO_NETTO) AS MonetaryValue
        FROM active GROUP BY 1""",
    "edges": """
        SELECT quantile_cont(cast(Recency AS DOUBLE), [0.25, 0.5, 0.75]) AS r,
               quantile_cont(cast(Frequency AS DOUBLE), [0.25, 0.5, 0.75]) AS f,
               quantile_cont(cast(MonetaryValue AS DOUBLE), [0.25, 0.5, 0.75]) AS m
        FROM rfm""",
    "scores": """
        SELECT rfm.*,
               CASE WHEN Recency <= r[1] THEN 4 WHEN Recency <= r[2] THEN 3 WHEN Recency <= r[3] THEN 2 ELSE 1 END AS R,
               CASE WHEN Frequency <= f[1] THEN 1 WHEN Frequency <= f[2] THEN 2 WHEN Frequency <= f[3] THEN 3 ELSE 4 END AS F,
               CASE WHEN cast(MonetaryValue AS DOUBLE) <= m[1] THEN 1 WHEN cast(MonetaryValue AS DOUBLE) <= m[2] THEN 2
                    WHEN cast(MonetaryValue AS DOUBLE) <= m[3] THEN 3 ELSE 4 END AS M
        FROM rfm, edges""",
    "classes": """
        SELECT ID_CLI, CASE R WHEN 1 THEN 'Low' WHEN 4 THEN 'High' ELSE 'Medium' END AS R_Class,
               CASE F WHEN 1 THEN 'Low' WHEN 4 THEN 'High' ELSE 'Medium' END AS F_Class,
               CASE M WHEN 1 THEN 'Low' WHEN 4 THEN 'High' ELSE 'Medium' END AS M_Class
        FROM scores""",
    "rf": """
        SELECT *, R_Class || '-' || F_Class AS Combine_Class,
               CASE R_Class || '-' || F_Class
                    WHEN 'Medium-High' THEN 'Top' WHEN 'Low-Medium' THEN 'Engaged' WHEN 'High-High' THEN 'Leaving Top'
                    WHEN 'Low-High' THEN 'Top' WHEN 'Low-Low' THEN 'One Timer' WHEN 'Medium-Medium' THEN 'Engaged'
                    WHEN 'High-Medium' THEN 'Leaving' WHEN 'Medium-Low' THEN 'One Timer'
                    WHEN 'High-Low' THEN 'Leaving' END AS RF_Class
        FROM classes""",
    "segments": """
        SELECT *, cast(R AS VARCHAR) || cast(F AS VARCHAR) || cast(M AS VARCHAR) AS RFM_Segment_Concat,
               R + F + M AS RFM_Score
        FROM scores""",
    "levels": """
        SELECT *, CASE WHEN RFM_Score >= 9 THEN 'Diamond' WHEN RFM_Score = 8 THEN 'Gold' WHEN RFM_Score = 7 THEN 'Silver'
                       WHEN RFM_Score = 6 THEN 'Bronze' WHEN RFM_Score = 5 THEN 'Copper' WHEN RFM_Score = 4 THEN 'Tin'
                       ELSE 'Cheap' END AS RFM_Level
        FROM segments""",
    "bought": "SELECT * EXCLUDE (DIREZIONE) FROM lines WHERE DIREZIONE <> -1",
    "support": """
        SELECT ID_ARTICOLO, count(DISTINCT ID_SCONTRINO) AS n_receipts,
               count(DISTINCT ID_SCONTRINO) / (SELECT count(DISTINCT ID_SCONTRINO) FROM bought) AS support
        FROM bought GROUP BY 1""",
    "high": "SELECT * FROM bought WHERE ID_ARTICOLO IN (SELECT ID_ARTICOLO FROM support WHERE support > 0.001)",
    "profile": """
        SELECT ID_ARTICOLO, COD_REPARTO AS REPARTO, cast(sum(IMPORTO_NETTO) AS DOUBLE) / count(*) AS IMPORTO_MEDIO,
               count(DISTINCT ID_SCONTRINO) / (SELECT count(DISTINCT ID_SCONTRINO) FROM bought) AS PERC_SCONTRINI
        FROM bought GROUP BY 1, 2""",
    "high_profile": """
        SELECT ID_ARTICOLO, COD_REPARTO AS REPARTO, cast(sum(IMPORTO_NETTO) AS DOUBLE) / count(*) AS IMPORTO_MEDIO
        FROM high GROUP BY 1, 2""",
    "coarse": """
        SELECT b.* REPLACE (cast(p_size AS BIGINT) AS ID_ARTICOLO)
        FROM bought b JOIN part ON ID_ARTICOLO = p_partkey""",
    "coarse_n": "SELECT count(DISTINCT ID_SCONTRINO) AS n FROM coarse",
    "items": """
        SELECT DISTINCT ID_SCONTRINO AS t, ID_ARTICOLO AS a FROM coarse WHERE ID_ARTICOLO IN (
            SELECT ID_ARTICOLO FROM coarse GROUP BY 1
            HAVING count(DISTINCT ID_SCONTRINO) / (SELECT n FROM coarse_n) > 0.001)""",
    "singles": """
        SELECT a, list(t) AS tickets FROM items GROUP BY 1""",
    "grown": """
        SELECT [a] AS items, tickets FROM singles
        UNION ALL
        SELECT list_append(g.items, s.a), list_intersect(g.tickets, s.tickets)
        FROM grown g JOIN singles s ON s.a > g.items[-1]
        WHERE len(list_intersect(g.tickets, s.tickets)) / (SELECT n FROM coarse_n) >= 0.001""",
    "counted": "SELECT items, len(tickets) AS freq FROM grown",
    "itemsets": """
        SELECT items, freq, n AS n_receipts, freq / n AS support, len(items) AS lunghezza
        FROM counted, coarse_n WHERE freq / n >= 0.001""",
    "splits": """
        SELECT list_sort(l.items) AS antecedents, list_sort(list_filter(s.items, lambda x: NOT list_contains(l.items, x))) AS consequents,
               s.freq, s.n_receipts, s.support, l.freq AS freq_a
        FROM itemsets s JOIN itemsets l ON len(l.items) < len(s.items) AND list_has_all(s.items, l.items)
        WHERE cast(s.freq AS DOUBLE) / l.freq >= 0.05""",
    "rules": """
        SELECT array_to_string(antecedents, ',') AS antecedents, array_to_string(consequents, ',') AS consequents,
               antecedents AS a_items, consequents AS c_items,
               cast(freq_a AS DOUBLE) / splits.n_receipts AS antecedent_support,
               cast(c.freq AS DOUBLE) / splits.n_receipts AS consequent_support, splits.support,
               cast(splits.freq AS DOUBLE) / freq_a AS confidence,
               cast(splits.freq AS DOUBLE) * splits.n_receipts / (cast(freq_a AS DOUBLE) * c.freq) AS lift,
               splits.support - (cast(freq_a AS DOUBLE) / splits.n_receipts) * (cast(c.freq AS DOUBLE) / splits.n_receipts) AS leverage,
               CASE WHEN splits.freq = freq_a THEN cast('inf' AS DOUBLE)
                    ELSE (1 - cast(c.freq AS DOUBLE) / splits.n_receipts) / (1 - cast(splits.freq AS DOUBLE) / freq_a) END AS conviction
        FROM splits JOIN itemsets c ON consequents = c.items""",
    "best": """
        SELECT *, row_number() OVER (ORDER BY lift DESC, antecedents, consequents) AS place
        FROM rules QUALIFY place <= 15""",
    "best_articles": "SELECT DISTINCT unnest(list_concat(a_items, c_items)) AS ID_ARTICOLO FROM best",
    "best_lines": "SELECT * FROM coarse WHERE ID_ARTICOLO IN (SELECT ID_ARTICOLO FROM best_articles)",
    "best_stats": """
        SELECT ID_ARTICOLO, cast(sum(IMPORTO_NETTO) AS DOUBLE) / count(IMPORTO_NETTO) AS IMPORTO_MEDIO,
               count(DISTINCT ID_SCONTRINO) AS NUMERO_ACQUISTI, count(DISTINCT ID_CLI) AS NUMERO_CLIENTI
        FROM best_lines GROUP BY 1""",
    "chosen": "SELECT ID_ARTICOLO AS article FROM best_stats ORDER BY NUMERO_ACQUISTI DESC, ID_ARTICOLO LIMIT 1",
    "bundle": """
        SELECT DISTINCT unnest(list_concat(a_items, c_items)) AS ID_ARTICOLO
        FROM (SELECT * FROM rules ORDER BY lift DESC, antecedents, consequents LIMIT 1)""",
    "bundle_tickets": """
        SELECT ID_SCONTRINO, count(DISTINCT ID_ARTICOLO) AS NUMERO_ARTICOLI
        FROM coarse WHERE ID_ARTICOLO IN (SELECT ID_ARTICOLO FROM bundle)
        GROUP BY 1 HAVING count(DISTINCT ID_ARTICOLO) = (SELECT count(*) FROM bundle)""",
    "bundle_days": """
        SELECT ID_CLI, DATA, row_number() OVER (PARTITION BY ID_CLI ORDER BY DATA DESC) AS back
        FROM (SELECT DISTINCT ID_CLI, DATA FROM coarse
              WHERE ID_ARTICOLO IN (SELECT ID_ARTICOLO FROM bundle)
                AND ID_SCONTRINO IN (SELECT ID_SCONTRINO FROM bundle_tickets))""",
    "customers": """
        SELECT l.*, a.EMAIL_PROVIDER, a.W_PHONE, a.TYP_CLI_ACCOUNT, a.TYP_JOB, c.CHURN, c.N_LINES
        FROM clean_loyalty l JOIN clean_accounts a ON l.ID_CLI = a.ID_CLI JOIN labelled c ON l.ID_CLI = c.ID_CLI""",
    "per_line": "SELECT customers.* FROM customers JOIN lines ON customers.ID_CLI = lines.ID_CLI",
    "near": """
        SELECT q.vec_id AS query_id, q.label AS own, t.vec_id AS train_id, t.label,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY
                   list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i:
                       (cast(q.embedding[i] AS DOUBLE) - cast(t.embedding[i] AS DOUBLE)) *
                       (cast(q.embedding[i] AS DOUBLE) - cast(t.embedding[i] AS DOUBLE)))), t.vec_id) AS place
        FROM embeddings q JOIN embeddings t ON q.vec_id <> t.vec_id QUALIFY place <= 24""",
    "scored": """
        SELECT n_chars AS threshold, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS p,
               sum(CASE WHEN quality = 1 THEN 0 ELSE 1 END) AS q
        FROM labels JOIN documents USING (doc_id) GROUP BY 1""",
    "cells": """
        SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp,
               count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn
        FROM labels""",
    "dealt": """
        SELECT ID_CLI, CHURN AS label,
               row_number() OVER (PARTITION BY CHURN ORDER BY md5(cast(ID_CLI AS VARCHAR) || '-0'), ID_CLI) AS place
        FROM customers""",
    "bayes_rows": """
        SELECT d.place % 10 AS fold, d.label, v.name, v.x
        FROM dealt d JOIN (
            SELECT ID_CLI, unnest([{'name': 'FIRST_ID_NEG', 'x': cast(FIRST_ID_NEG AS DOUBLE)},
                                   {'name': 'W_PHONE', 'x': cast(W_PHONE AS DOUBLE)},
                                   {'name': 'TYP_CLI_ACCOUNT', 'x': cast(TYP_CLI_ACCOUNT AS DOUBLE)}], recursive := true)
            FROM customers) v USING (ID_CLI)""",
    "bayes_folds": "SELECT unnest(range(0, 10)) AS fold",
    "bayes_spread": """
        SELECT f.fold, r.name, CASE WHEN stddev_pop(r.x) > 1e-12 THEN stddev_pop(r.x) ELSE 1 END AS std,
               var_pop(r.x) AS whole FROM bayes_rows r JOIN bayes_folds f ON r.fold <> f.fold GROUP BY 1, 2""",
    "bayes_most": "SELECT fold, max(whole / (std * std)) AS most FROM bayes_spread GROUP BY 1",
    "bayes_facts": """
        SELECT f.fold, r.name, r.label, count(*) AS n, avg(r.x) AS mean, var_pop(r.x) AS var
        FROM bayes_rows r JOIN bayes_folds f ON r.fold <> f.fold GROUP BY 1, 2, 3""",
    "bayes_odds": """
        SELECT d.ID_CLI, d.place % 10 AS fold, d.label AS truth, b.label,
               max(ln(b.n / (SELECT count(*) FROM dealt o WHERE o.place % 10 <> d.place % 10)))
               + sum(-0.5 * (ln(2 * pi() * (b.var + 1e-9 * m.most * s.std * s.std))
                             + (v.x - b.mean) * (v.x - b.mean) / (b.var + 1e-9 * m.most * s.std * s.std))) AS odds
        FROM dealt d JOIN (
            SELECT ID_CLI, unnest([{'name': 'FIRST_ID_NEG', 'x': cast(FIRST_ID_NEG AS DOUBLE)},
                                   {'name': 'W_PHONE', 'x': cast(W_PHONE AS DOUBLE)},
                                   {'name': 'TYP_CLI_ACCOUNT', 'x': cast(TYP_CLI_ACCOUNT AS DOUBLE)}], recursive := true)
            FROM customers) v ON v.ID_CLI = d.ID_CLI
        JOIN bayes_facts b ON b.fold = d.place % 10 AND b.name = v.name
        JOIN bayes_spread s ON s.fold = b.fold AND s.name = b.name
        JOIN bayes_most m ON m.fold = b.fold
        GROUP BY ALL""",
    "fold_scores": """
        SELECT cast(a.fold AS INTEGER) AS fold, count(*) AS n,
               count(*) FILTER ((b.odds > a.odds) = (a.truth = 1)) AS n_right
        FROM bayes_odds a JOIN bayes_odds b ON a.ID_CLI = b.ID_CLI AND a.label = 0 AND b.label = 1 GROUP BY 1""",
    "class_sizes": """
        SELECT CHURN AS label, count(*) AS n, (SELECT count(*) FROM customers) AS total,
               cast(ceil(round((SELECT count(*) FROM customers) * 0.9, 6)) AS BIGINT) AS wanted
        FROM customers GROUP BY 1""",
    "class_shares": """
        SELECT label, wanted, cast(floor(n * wanted / total) AS BIGINT) AS whole,
               row_number() OVER (ORDER BY floor(n * wanted / total) - n * wanted / total, label) AS turn
        FROM class_sizes""",
}

_DAY = "%Y-%m-%d"
_TIME = "%Y-%m-%d %H:%M:%S"


def _day(*names: str) -> str:
    return ", ".join(f"strftime({n}, '{_DAY}') AS {n}" for n in names)


def _time(*names: str) -> str:
    return ", ".join(f"strftime({n}, '{_TIME}') AS {n}" for n in names)


def _real(*names: str) -> str:
    return ", ".join(f"cast({n} AS DOUBLE) AS {n}" for n in names)


_SALE = "ID_SCONTRINO, ID_CLI, ID_NEG, ID_ARTICOLO, COD_REPARTO, DIREZIONE"
_MONEY = _real("IMPORTO_LORDO", "SCONTO")
_MONEY_NET = _real("IMPORTO_LORDO", "SCONTO", "IMPORTO_NETTO")
_CARD_DATES = _time("LAST_DT_ACTIVE", "FIRST_DT_ACTIVE")
_BOUGHT = ("ID_SCONTRINO, ID_CLI, ID_NEG, ID_ARTICOLO, COD_REPARTO, ORA, "
           f"{_MONEY_NET}, {_time('DATETIME')}, {_day('DATA')}")
_PROFILE = ["LAST_TYP_CLI_FID", "LAST_STATUS_FID", "FIRST_ID_NEG", "NUM_FIDs", "W_PHONE", "TYP_CLI_ACCOUNT"]
_VIF = ["FIRST_ID_NEG", "W_PHONE", "TYP_CLI_ACCOUNT"]


def _beyond_first(table: str, subset: str, label: str) -> str:
    return (f"SELECT '{table}' AS table_name, '{label}' AS subset, cast(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates "
            f"FROM (SELECT count(*) AS n FROM {table} GROUP BY {subset})")


def _within_direction(key: str) -> str:
    return f"""
        SELECT {key}, DIREZIONE, count(DISTINCT ID_SCONTRINO) AS TOT_TICs, count(DISTINCT ID_CLI) AS TOT_CLIs,
               count(DISTINCT ID_SCONTRINO) / max(t.tics) AS PERCENT_TICs,
               count(DISTINCT ID_CLI) / max(t.clis) AS PERCENT_CLIs
        FROM lines JOIN (SELECT DIREZIONE, count(DISTINCT ID_SCONTRINO) AS tics, count(DISTINCT ID_CLI) AS clis
                         FROM lines GROUP BY 1) t USING (DIREZIONE)
        GROUP BY 1, 2"""


def _coverage(name: str, left: str, right: str, key: str) -> str:
    return (f"SELECT '{name}' AS check_name, CASE WHEN {key} IN (SELECT {key} FROM {right}) THEN 1 ELSE 0 END AS found, "
            f"count(*) AS n FROM {left} GROUP BY 2")


def _filled(table: str, kinds: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{kind}' AS data_type, count(*) AS n_rows, count({c}) AS n_filled FROM {table}"
        for c, kind in kinds.items())


def _summary(columns: list[str]) -> str:
    one = """
        SELECT '{c}' AS column_name, cast(sum(n) AS BIGINT) AS n, count(*) AS n_unique,
               arg_min(v, rank) AS top, max(n) AS freq
        FROM (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS rank
              FROM (SELECT {c} AS v, count(*) AS n FROM rf GROUP BY 1))"""
    return " UNION ALL ".join(one.format(c=c) for c in columns)


def _vif() -> str:
    g = {(i, j): f"sum(cast({_VIF[i]} AS DOUBLE) * {_VIF[j]})" for i in range(3) for j in range(i, 3)}
    sums = ", ".join(f"{sql} AS g{i}{j}" for (i, j), sql in g.items())
    det = "(g00 * (g11 * g22 - g12 * g12) - g01 * (g01 * g22 - g12 * g02) + g02 * (g01 * g12 - g11 * g02))"
    minors = ["g00 * (g11 * g22 - g12 * g12)", "g11 * (g00 * g22 - g02 * g02)", "g22 * (g00 * g11 - g01 * g01)"]
    return " UNION ALL ".join(
        f"SELECT '{name}' AS variable, round({minor} / {det}, 6) AS vif FROM (SELECT {sums} FROM per_line)"
        for name, minor in zip(_VIF, minors))


def _dummies() -> str:
    levels = {
        "LAST_COD_FID": ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
        "TYP_JOB": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    }
    flags = ", ".join(f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for c, vs in levels.items() for v in vs)
    return f"SELECT ID_CLI, {flags} FROM customers"


def _vif_profile() -> str:
    """The inverse of the sums of products by exchange steps, one pivot after the other."""
    k = len(_PROFILE)
    cells = ", ".join(f"sum(cast({a} AS DOUBLE) * {b})" for a in _PROFILE for b in _PROFILE)
    steps = [f"g AS (SELECT [{cells}] AS a FROM per_line)", "s0 AS (SELECT a FROM g)"]
    for p in range(k):
        at = lambda i, j: f"a[({i}) * {k} + {j} + 1]"
        steps.append(f"""s{p + 1} AS (SELECT list_transform(range(0, {k * k}), lambda t: CASE
            WHEN t // {k} = {p} AND t % {k} = {p} THEN 1 / {at(p, p)}
            WHEN t // {k} = {p} THEN a[t + 1] / {at(p, p)}
            WHEN t % {k} = {p} THEN -a[t + 1] / {at(p, p)}
            ELSE a[t + 1] - {at(f't // {k}', p)} * {at(p, f't % {k}')} / {at(p, p)} END) AS a FROM s{p})""")
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS variable, round(g.a[{i * k + i + 1}] * s{k}.a[{i * k + i + 1}], 4) AS vif FROM g, s{k}"
        for i, name in enumerate(_PROFILE))
    return "WITH " + ",\n".join(steps) + " " + rows


_ORACLE: dict[str, str] = {
    "csv_roundtrip": "SELECT * FROM raw_transactions",
    "decimal_comma": """
        SELECT ID_SCONTRINO, ID_ARTICOLO, IMPORTO_LORDO, cast(replace(IMPORTO_LORDO, ',', '.') AS DOUBLE) AS gross,
               cast(replace(SCONTO, ',', '.') AS DOUBLE) AS discount
        FROM raw_transactions""",
    "tx_typed": f"""
        SELECT {_SALE}, {_MONEY}, {_time('DATETIME')}, cast(hour(DATETIME) AS INTEGER) AS ORA,
               strftime(DATETIME, '{_DAY}') AS DATA
        FROM transactions""",
    "tx_net": f"SELECT {_SALE}, {_MONEY_NET}, {_time('DATETIME')} FROM net",
    "tx_identical": f"SELECT {_SALE}, {_MONEY_NET}, {_time('DATETIME')} FROM copies WHERE n_full > 1",
    "tx_dedup": f"""
        SELECT {_SALE}, {_MONEY}, {_time('DATETIME')} FROM (
            SELECT *, sum(CASE WHEN n_full = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {_SALE}, DATETIME) AS n_lone
            FROM (SELECT *, count(*) OVER (PARTITION BY {_SALE}, DATETIME, IMPORTO_LORDO, SCONTO) AS n_full
                  FROM transactions))
        WHERE n_full > 1 OR n_lone = 1""",
    "tx_clean": f"SELECT {_SALE}, ORA, {_MONEY_NET}, {_time('DATETIME')}, {_day('DATA')} FROM lines",
    "accounts_clean": "SELECT * FROM clean_accounts",
    "addresses_clean": "SELECT * FROM clean_addresses",
    "privacy_clean": "SELECT * FROM privacy",
    "loyalty_first": f"""
        SELECT ID_CLI, ID_FID, ID_NEG AS FIRST_ID_NEG, strftime(DT_ACTIVE, '{_TIME}') AS FIRST_DT_ACTIVE
        FROM ranked_cards WHERE from_first = 1""",
    "first_per_key": f"""
        SELECT ID_CLI, strftime(DT_ACTIVE, '{_TIME}') AS DT_ACTIVE, ID_FID FROM ranked_cards WHERE from_first = 1""",
    "loyalty_last": f"""
        SELECT ID_CLI, ID_FID, COD_FID AS LAST_COD_FID, TYP_CLI_FID AS LAST_TYP_CLI_FID,
               STATUS_FID AS LAST_STATUS_FID, strftime(DT_ACTIVE, '{_TIME}') AS LAST_DT_ACTIVE
        FROM ranked_cards WHERE from_last = 1""",
    "loyalty_clean": f"SELECT * REPLACE ({_CARD_DATES}) FROM clean_loyalty",
    "provider_capped": "SELECT ID_CLI, EMAIL_PROVIDER FROM clean_accounts",
    "null_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_nulls, "
        f"CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS any_null FROM accounts"
        for c in ("ID_CLI", "EMAIL_PROVIDER", "W_PHONE", "ID_ADDRESS", "TYP_CLI_ACCOUNT", "TYP_JOB")),
    "table_profile": _filled("lines", {
        "ID_SCONTRINO": "string", "ID_CLI": "bigint", "ID_NEG": "bigint", "ID_ARTICOLO": "bigint",
        "COD_REPARTO": "int", "DIREZIONE": "int", "IMPORTO_LORDO": "decimal(18,2)", "SCONTO": "decimal(18,2)",
        "DATETIME": "timestamp_ntz", "ORA": "int", "DATA": "date", "IMPORTO_NETTO": "decimal(18,2)"}),
    "receipt_lookup": f"""
        SELECT {_SALE}, {_MONEY}, {_time('DATETIME')}
        FROM transactions JOIN (
            SELECT ID_SCONTRINO, ID_CLI, ID_ARTICOLO FROM transactions
            ORDER BY IMPORTO_LORDO DESC, ID_SCONTRINO, ID_CLI, ID_ARTICOLO LIMIT 1) AS dearest
        USING (ID_SCONTRINO, ID_CLI, ID_ARTICOLO)""",
    "zero_net_rows": f"""
        SELECT {_SALE}, ORA, {_MONEY_NET}, {_time('DATETIME')}, {_day('DATA')} FROM lines WHERE IMPORTO_NETTO = 0""",
    "zero_net_audit": "SELECT count(*) AS n_rows, count(*) FILTER (IMPORTO_NETTO = 0) AS n_zero_net FROM net",
    "dup_report": " UNION ALL ".join([
        _beyond_first("transactions", f"{_SALE}, DATETIME, IMPORTO_LORDO, SCONTO", "rows"),
        _beyond_first("transactions", f"{_SALE}, DATETIME", "sale"),
        _beyond_first("loyalty", "ID_CLI, ID_FID, ID_NEG, COD_FID, TYP_CLI_FID, STATUS_FID, DT_ACTIVE", "rows"),
        _beyond_first("loyalty", "ID_FID", "ID_FID"), _beyond_first("loyalty", "ID_CLI", "ID_CLI"),
        _beyond_first("loyalty", "ID_CLI, ID_FID", "ID_CLI, ID_FID"),
        _beyond_first("accounts", "ID_CLI, EMAIL_PROVIDER, W_PHONE, ID_ADDRESS, TYP_CLI_ACCOUNT, TYP_JOB", "rows"),
        _beyond_first("accounts", "ID_CLI", "ID_CLI"),
        _beyond_first("addresses", "ID_ADDRESS, CAP", "rows"), _beyond_first("addresses", "ID_ADDRESS", "ID_ADDRESS"),
        _beyond_first("privacy", "ID_CLI, FLAG_PRIVACY_1, FLAG_PRIVACY_2, FLAG_DIRECT_MKT", "rows"),
        _beyond_first("privacy", "ID_CLI", "ID_CLI")]),
    "key_coverage": " UNION ALL ".join([
        _coverage("loyalty in accounts", "loyalty", "accounts", "ID_CLI"),
        _coverage("accounts in addresses", "accounts", "clean_addresses", "ID_ADDRESS"),
        _coverage("loyalty in privacy", "loyalty", "privacy", "ID_CLI"),
        _coverage("privacy in loyalty", "privacy", "loyalty", "ID_CLI")]),
    "tx_overview": f"""
        SELECT strftime(min(DATA), '{_DAY}') AS MIN_DATE, strftime(max(DATA), '{_DAY}') AS MAX_DATE,
               count(DISTINCT ID_SCONTRINO) AS TOT_TICs, count(DISTINCT ID_CLI) AS TOT_CLIs
        FROM lines""",
    "dist_direction": """
        SELECT DIREZIONE, TOT_TICs, TOT_CLIs, TOT_TICs / sum(TOT_TICs) OVER () AS PERCENT_TICs,
               TOT_CLIs / (SELECT count(DISTINCT ID_CLI) FROM lines) AS PERCENT_CLIs
        FROM (SELECT DIREZIONE, count(DISTINCT ID_SCONTRINO) AS TOT_TICs, count(DISTINCT ID_CLI) AS TOT_CLIs
              FROM lines GROUP BY 1)""",
    "dist_hour": _within_direction("ORA"),
    "dist_department": _within_direction("COD_REPARTO"),
    "dist_article": """
        SELECT ID_ARTICOLO, DIREZIONE, count(DISTINCT ID_SCONTRINO) AS TOT_TICs, count(DISTINCT ID_CLI) AS TOT_CLIs
        FROM lines GROUP BY 1, 2""",
    "receipts_per_customer": "SELECT * FROM receipts",
    "customers_at_least": """
        SELECT k AS at_least, (SELECT count(*) FROM receipts WHERE TOT_SCONTRINI >= k) AS n_clients
        FROM (SELECT cast(unnest(range(1, 7)) AS INTEGER) AS k)""",
    "top_customers": "SELECT * FROM receipts ORDER BY TOT_SCONTRINI DESC, ID_CLI LIMIT 3",
    "fid_distribution": """
        SELECT NUM_FIDs, NUM_DATEs, count(*) AS TOT_CLIs, count(*) / (SELECT count(*) FROM card_counts) AS PERCENT_CLIs
        FROM card_counts GROUP BY 1, 2""",
    "dist_loyalty": " UNION ALL ".join(
        f"SELECT '{c}' AS variable, cast({c} AS VARCHAR) AS value, count(DISTINCT ID_CLI) AS TOT_CLIs, "
        f"count(DISTINCT ID_CLI) / (SELECT count(*) FROM clean_loyalty) AS PERCENT_CLIs FROM clean_loyalty GROUP BY 2"
        for c in ("LAST_COD_FID", "LAST_TYP_CLI_FID", "LAST_STATUS_FID", "NUM_FIDs")),
    "value_counts": """
        SELECT EMAIL_PROVIDER, count(*) AS n, count(*) / (SELECT count(*) FROM filled_accounts) * 100 AS percent
        FROM filled_accounts GROUP BY 1""",
    "provider_cumulative": """
        SELECT EMAIL_PROVIDER, n, n_upto, n_upto / (SELECT count(DISTINCT ID_CLI) FROM filled_accounts) AS cumulative_share
        FROM (SELECT *, cast(sum(n) OVER (ORDER BY n DESC, EMAIL_PROVIDER ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_upto
              FROM (SELECT EMAIL_PROVIDER, count(*) AS n FROM filled_accounts GROUP BY 1))""",
    "tier_activity": """
        SELECT LAST_COD_FID, count(*) AS n FROM lines JOIN clean_loyalty USING (ID_CLI) GROUP BY 1""",
    "next_purchase": f"""
        SELECT ID_CLI, {_day('PRIMO_ACQUISTO', 'ULTIMO_ACQUISTO', 'PENULTIMO_ACQUISTO')}, NUMERO_ACQUISTI,
               NEXT_PURCHASE_DAY
        FROM gaps""",
    "npd_summary": """
        SELECT count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min,
               quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75, max(v) AS max
        FROM (SELECT cast(NEXT_PURCHASE_DAY AS DOUBLE) AS v FROM gaps)""",
    "npd_percentiles": " UNION ALL ".join(
        f"SELECT {p} AS percent, round(quantile_cont(cast(NEXT_PURCHASE_DAY AS DOUBLE), {p / 100}), 6) AS days FROM gaps"
        for p in (80, 85, 90)),
    "npd_curve": """
        SELECT NEXT_PURCHASE_DAY, n, n_upto, n_upto / (SELECT count(*) FROM gaps) AS share
        FROM (SELECT *, cast(sum(n) OVER (ORDER BY NEXT_PURCHASE_DAY) AS BIGINT) AS n_upto
              FROM (SELECT NEXT_PURCHASE_DAY, count(*) AS n FROM gaps GROUP BY 1))""",
    "histogram": """
        WITH s AS (SELECT cast(min(NEXT_PURCHASE_DAY) AS DOUBLE) AS lo, cast(max(NEXT_PURCHASE_DAY) AS DOUBLE) AS hi
                   FROM gaps),
             b AS (SELECT least(floor((cast(NEXT_PURCHASE_DAY AS DOUBLE) - lo) * 30 / (hi - lo)), 29) AS bin, count(*) AS n
                   FROM gaps, s GROUP BY 1)
        SELECT r.bin, round(lo + r.bin * ((hi - lo) / 30), 6) AS bin_from, round(lo + (r.bin + 1) * ((hi - lo) / 30), 6) AS bin_to,
               coalesce(n, 0) AS n
        FROM (SELECT unnest(range(0, 30)) AS bin) r CROSS JOIN s LEFT JOIN b ON r.bin = b.bin""",
    "churn_label": f"SELECT * REPLACE ({_day('LAST_PURCHASE_DATE')}, {_real('TOTAL_PURCHASE')}) FROM labelled",
    "churn_tx": f"""
        SELECT {_SALE}, ORA, {_real('IMPORTO_NETTO')}, {_time('DATETIME')}, {_day('DATA')},
               {_day('LAST_PURCHASE_DATE')}, {_real('TOTAL_PURCHASE')}, CHURN
        FROM lines JOIN labelled USING (ID_CLI)""",
    "active_lines": f"SELECT {_SALE}, ORA, {_MONEY_NET}, {_time('DATETIME')}, {_day('DATA')} FROM active",
    "rfm_base": f"SELECT * REPLACE ({_real('MonetaryValue')}) FROM rfm",
    "rfm_scores": f"SELECT * REPLACE ({_real('MonetaryValue')}) FROM scores",
    "rfm_classes": "SELECT * FROM classes",
    "rfm_class_summary": _summary(["R_Class", "F_Class", "M_Class", "RF_Class"]),
    "rf_matrix": """
        SELECT Combine_Class, RF_Class, count(*) AS n,
               round_even(count(*) / (SELECT count(*) FROM rf) * 100, 2) AS percent
        FROM rf GROUP BY 1, 2""",
    "rfm_segments": "SELECT ID_CLI, RFM_Segment_Concat, RFM_Score FROM segments",
    "rfm_segment_count": "SELECT count(DISTINCT RFM_Segment_Concat) AS n_segments FROM segments",
    "rfm_levels": "SELECT ID_CLI, RFM_Score, RFM_Level FROM levels",
    "rfm_level_summary": """
        SELECT RFM_Level, round_even(cast(sum(Recency) AS DOUBLE) / count(*), 1) AS RecencyMean,
               round_even(cast(sum(Frequency) AS DOUBLE) / count(*), 1) AS FrequencyMean,
               round_even(cast(sum(MonetaryValue) AS DOUBLE) / count(*), 1) AS MonetaryMean, count(*) AS Count,
               round_even(count(*) / (SELECT count(*) FROM levels) * 100, 2) AS Percent
        FROM levels GROUP BY 1""",
    "mba_lines": f"SELECT {_BOUGHT} FROM bought WHERE DATA >= (SELECT day FROM cutoff)",
    "article_profile": "SELECT * FROM profile",
    "articles_per_department": "SELECT REPARTO, count(*) AS n_articles FROM profile GROUP BY 1",
    "article_support": "SELECT * FROM support",
    "support_buckets": """
        SELECT CASE WHEN support > 0.01 THEN 'maggiore 1%' WHEN support > 0.001 THEN '0.1%-1%'
                    WHEN support > 0.0001 THEN '0.01%-0.1%' WHEN support > 0.00001 THEN '0.001%-0.01%'
                    WHEN support > 0.000001 THEN '0.0001%-0.001%' ELSE 'minore 0.0001%' END AS band,
               count(*) AS n_articles
        FROM support GROUP BY 1""",
    "high_support_tx": f"SELECT {_BOUGHT} FROM high",
    "outside_department": f"SELECT {_BOUGHT} FROM bought WHERE COD_REPARTO <> 3",
    "box_stats": """
        WITH q AS (SELECT REPARTO, count(*) AS n, quantile_cont(IMPORTO_MEDIO, 0.25) AS q1,
                          quantile_cont(IMPORTO_MEDIO, 0.5) AS median, quantile_cont(IMPORTO_MEDIO, 0.75) AS q3
                   FROM profile GROUP BY 1)
        SELECT REPARTO, max(n) AS n, round(max(q1), 6) AS q1, round(max(median), 6) AS median, round(max(q3), 6) AS q3,
               min(CASE WHEN IMPORTO_MEDIO >= q1 - (q3 - q1) * 1.5 THEN IMPORTO_MEDIO END) AS whisker_low,
               max(CASE WHEN IMPORTO_MEDIO <= q3 + (q3 - q1) * 1.5 THEN IMPORTO_MEDIO END) AS whisker_high
        FROM profile JOIN q USING (REPARTO) GROUP BY 1""",
    "kde_grid": """
        WITH s AS (SELECT min(IMPORTO_MEDIO) AS lo, max(IMPORTO_MEDIO) AS hi, count(*) AS n,
                          stddev_samp(IMPORTO_MEDIO) * pow(count(*), -0.2) AS bw FROM high_profile),
             g AS (SELECT cast(point AS INTEGER) AS point, lo + point * (hi - lo) / 19 AS x, n, bw
                   FROM (SELECT unnest(range(0, 20)) AS point), s)
        SELECT point, round(max(x), 6) AS x,
               round(sum(exp(-0.5 * ((x - IMPORTO_MEDIO) / bw) * ((x - IMPORTO_MEDIO) / bw)) / (bw * sqrt(2 * pi()) * n))
                     * 1e6, 6) AS density_per_million
        FROM g CROSS JOIN high_profile GROUP BY 1""",
    "basket_long": """
        SELECT ID_SCONTRINO, ID_ARTICOLO, count(*) AS units, 1 AS present FROM high GROUP BY 1, 2""",
    "basket_arrays": """
        SELECT ID_SCONTRINO,
               coalesce(array_to_string(list_sort(list(DISTINCT ID_ARTICOLO) FILTER (ID_ARTICOLO IN (
                   SELECT ID_ARTICOLO FROM support WHERE support > 0.001))), ','), '') AS items
        FROM bought GROUP BY 1""",
    "freq_itemsets": "SELECT * REPLACE (array_to_string(items, ',') AS items) FROM itemsets",
    "rules": """
        SELECT * EXCLUDE (a_items, c_items) REPLACE (round(leverage, 9) AS leverage, round(conviction, 9) AS conviction)
        FROM rules""",
    "rule_counts": "SELECT count(*) AS n_rules, count(*) FILTER (lift >= 1) AS n_lift_from_1 FROM rules",
    "strong_rules": """
        SELECT antecedents, consequents, support, confidence, lift FROM rules WHERE support > 0.002 AND lift >= 1""",
    "redundant_rules": """
        SELECT antecedents, consequents, confidence FROM rules
        QUALIFY row_number() OVER (PARTITION BY consequents, confidence ORDER BY antecedents) > 1""",
    "top_rules": """
        SELECT 'itemset' || place AS NOME, antecedents, consequents, support, confidence, lift FROM best""",
    "rule_edges": "SELECT DISTINCT antecedents AS src, consequents AS dst FROM best",
    "rule_articles": f"SELECT {_BOUGHT} FROM best_lines",
    "article_stats": "SELECT * FROM best_stats",
    "rule_lookup": """
        SELECT DISTINCT article, 'influenced_by' AS relation, antecedents AS items
        FROM best, chosen WHERE list_contains(c_items, article)
        UNION ALL
        SELECT DISTINCT article, 'influences', cast(unnest(c_items) AS VARCHAR)
        FROM best, chosen WHERE list_contains(a_items, article)""",
    "rule_value": """
        WITH v AS (
            SELECT place, antecedents, consequents,
                   (SELECT sum(IMPORTO_MEDIO) FROM best_stats WHERE list_contains(a_items, ID_ARTICOLO)) AS a,
                   (SELECT sum(IMPORTO_MEDIO) FROM best_stats WHERE list_contains(c_items, ID_ARTICOLO)) AS c
            FROM best)
        SELECT 'itemset' || place AS NOME, antecedents, consequents, round(a, 4) AS IMPORTO_MEDIO_ANTECEDENTS,
               round(c, 4) AS IMPORTO_MEDIO_CONSEQUENTS, round(a + c, 4) AS IMPORTO_MEDIO_TOTALE
        FROM v""",
    "bundle_receipts": "SELECT * FROM bundle_tickets",
    "bundle_interval": """
        SELECT count(*) AS n_clients, avg(gap) AS mean_days FROM (
            SELECT max(DATA) - max(CASE WHEN back = 2 THEN DATA END) AS gap
            FROM bundle_days GROUP BY ID_CLI HAVING count(*) > 1)""",
    "feature_table": f"SELECT * REPLACE ({_CARD_DATES}) FROM customers",
    "churn_rate": """
        SELECT CASE WHEN CHURN = 0 THEN 'No' ELSE 'Yes' END AS churn_label, count(*) AS n,
               count(*) / (SELECT count(*) FROM per_line) * 100 AS churn_rate
        FROM per_line GROUP BY 1""",
    "churn_by_tier": """
        SELECT LAST_COD_FID, count(*) FILTER (CHURN = 0) AS No, count(*) FILTER (CHURN = 1) AS Yes,
               count(*) FILTER (CHURN = 0) * 100.0::DOUBLE / count(*) AS No_percent,
               count(*) FILTER (CHURN = 1) * 100.0::DOUBLE / count(*) AS Yes_percent
        FROM per_line GROUP BY 1""",
    "corr_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS var_x, '{b}' AS var_y, round(corr({a}, {b}), 6) AS corr FROM per_line"
        for i, a in enumerate(_PROFILE) for b in _PROFILE[i + 1:]),
    "corr_with_churn": "SELECT variable, corr, CASE WHEN corr > 0 THEN 'positive' ELSE 'negative' END AS sign FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS variable, round(corr({c}, CHURN), 6) AS corr FROM per_line" for c in _PROFILE) + ")",
    "vif": _vif(),
    "vif_profile": _vif_profile(),
    "dummies": _dummies(),
    "dummies_long": """
        WITH held AS (SELECT ID_CLI, 'LAST_COD_FID' AS variable, LAST_COD_FID AS level FROM customers
                       UNION ALL SELECT ID_CLI, 'TYP_JOB', TYP_JOB FROM customers),
             places AS (SELECT variable, level, row_number() OVER (PARTITION BY variable ORDER BY level) - 1 AS place
                        FROM (SELECT DISTINCT variable, level FROM held WHERE level IS NOT NULL))
        SELECT ID_CLI, variable, level, place FROM held JOIN places USING (variable, level) WHERE place > 0""",
    "cv_naive_bayes": "SELECT fold, n, n_right FROM fold_scores",
    "fold_boxes": """
        WITH q AS (SELECT quantile_cont(n_right / n, 0.25) AS q1, quantile_cont(n_right / n, 0.5) AS median,
                          quantile_cont(n_right / n, 0.75) AS q3 FROM fold_scores)
        SELECT 'Gaussian NB' AS model, count(*) AS n, round(max(q1), 9) AS q1, round(max(median), 9) AS median,
               round(max(q3), 9) AS q3,
               round(min(CASE WHEN n_right / n >= q1 - (q3 - q1) * 1.5 THEN n_right / n END), 9) AS whisker_low,
               round(max(CASE WHEN n_right / n <= q3 + (q3 - q1) * 1.5 THEN n_right / n END), 9) AS whisker_high
        FROM fold_scores, q""",
    "clean_tables": """
        SELECT 'transactions' AS table_name, count(*) AS n_rows, 12 AS n_columns FROM lines
        UNION ALL SELECT 'loyalty', count(*), 9 FROM clean_loyalty
        UNION ALL SELECT 'accounts', count(*), 6 FROM clean_accounts
        UNION ALL SELECT 'addresses', count(*), 2 FROM clean_addresses
        UNION ALL SELECT 'privacy', count(*), 4 FROM privacy""",
    "standardise": "SELECT ID_CLI, " + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in _VIF) + " FROM customers",
    "decile_rank": """
        SELECT c_custkey, c_acctbal, cast(11 - greatest(1, ceil((r - 1) * 10 / (n - 1))) AS INTEGER) AS Ranking
        FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER () AS n
              FROM customer)""",
    "knn_vote": """
        SELECT query_id, 22 AS k, label AS prediction FROM (
            SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, label) AS rank
            FROM near WHERE place <= 22 GROUP BY 1, 2)
        WHERE rank = 1""",
    "knn_sweep": """
        WITH v AS (
            SELECT query_id, own, k, label,
                   row_number() OVER (PARTITION BY query_id, k ORDER BY count(*) DESC, label) AS rank
            FROM near JOIN (SELECT cast(unnest(range(1, 25)) AS INTEGER) AS k) ON place <= k
            GROUP BY 1, 2, 3, 4)
        SELECT k, count(*) AS n, count(*) FILTER (label = own) AS n_right, count(*) FILTER (label = own) / count(*) AS accuracy
        FROM v WHERE rank = 1 GROUP BY 1""",
    "binary_metrics": """
        SELECT tp, fp, fn, tn, tp + fp + fn + tn AS n, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
               (fp + fn) / (tp + fp + fn + tn) AS error_rate, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy,
               tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, tp * 2 / (tp * 2 + fn + fp) AS f1,
               tp * 5 / (tp * 5 + fn * 4 + fp) AS f2
        FROM cells""",
    "roc_curve": """
        SELECT threshold, sum(q) OVER w / (SELECT sum(q) FROM scored) AS fpr, sum(p) OVER w / (SELECT sum(p) FROM scored) AS tpr
        FROM scored WINDOW w AS (ORDER BY threshold DESC)""",
    "stratified_split": """
        SELECT ID_CLI, dealt.label, CASE WHEN place <= whole + CASE WHEN turn <= wanted - (SELECT sum(whole) FROM class_shares)
                                                        THEN 1 ELSE 0 END THEN 'test' ELSE 'train' END AS part
        FROM dealt JOIN class_shares ON dealt.label = class_shares.label""",
}


def _used(sql: str) -> set[str]:
    return {word for word in re.findall(r"[A-Za-z_]\w*", sql) if word in _TABLES}


def _with_tables(sql: str) -> str:
    """Puts the table expressions that a query needs in front of it, in their order of definition."""
    needed: set[str] = set()
    new = _used(sql)
    while new:
        needed |= new
        new = set().union(*[_used(_TABLES[name]) for name in new]) - needed  # grown names itself
    heads = [f"{name} AS ({_TABLES[name]})" for name in _TABLES if name in needed]
    body = sql.strip()
    if not heads:
        return body
    if body.startswith("WITH "):
        return "WITH RECURSIVE " + ",\n".join(heads) + ",\n" + body[len("WITH "):]
    return "WITH RECURSIVE " + ",\n".join(heads) + "\n" + body


#: Analyses of the lines from the cutoff day on: the SQL of the whole calendar over cut purchase lines.
_RECENT = {"recent_itemsets": "freq_itemsets", "recent_rules": "rules", "recent_top_rules": "top_rules"}


def oracle_sql() -> dict[str, str]:
    found = {name: _with_tables(sql) for name, sql in _ORACLE.items()}
    bought = _TABLES["bought"]
    cut = bought + " AND (DATA IS NULL OR DATA >= (SELECT day FROM cutoff))"
    for name, like in _RECENT.items():
        _TABLES["bought"] = cut
        found[name] = _with_tables(_ORACLE[like])
    _TABLES["bought"] = bought
    return found
