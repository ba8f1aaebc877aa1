"""Scalar function families, each over a whole table."""

from __future__ import annotations

from .registry import sql_query

sql_query("fn_string", "customer", """
    SELECT c_custkey, upper(c_name) AS u, CAST(length(c_name) AS BIGINT) AS n, CAST(octet_length(c_name) AS BIGINT) AS b, substr(c_name, 3, 5) AS s, split(c_name, '#')[0] AS head,
           concat_ws('-', c_mktsegment, c_name) AS cw, trim(concat('  ', c_mktsegment, ' ')) AS t, replace(c_name, 'Customer', 'C') AS rp, translate(c_name, '#0', '_o') AS tr,
           lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '*') AS rpd, reverse(c_name) AS rv, repeat('ab', 2) AS rep, CAST(instr(c_name, '#') AS BIGINT) AS i,
           CAST(levenshtein(c_mktsegment, 'BUILDING') AS BIGINT) AS lev, CAST(ascii(c_mktsegment) AS BIGINT) AS a FROM customer""", """
    SELECT c_custkey, upper(c_name) AS u, length(c_name) AS n, strlen(c_name) AS b, substr(c_name, 3, 5) AS s, split_part(c_name, '#', 1) AS head,
           concat_ws('-', c_mktsegment, c_name) AS cw, trim(concat('  ', c_mktsegment, ' ')) AS t, replace(c_name, 'Customer', 'C') AS rp, translate(c_name, '#0', '_o') AS tr,
           lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '*') AS rpd, reverse(c_name) AS rv, repeat('ab', 2) AS rep, instr(c_name, '#') AS i,
           levenshtein(c_mktsegment, 'BUILDING') AS lev, ascii(c_mktsegment)::BIGINT AS a FROM customer""")
sql_query("fn_regex", "documents", r"""
    SELECT doc_id, regexp_extract(text, '([A-Za-z]+)ing', 1) AS stem, CAST(regexp_count(text, '[0-9]+') AS BIGINT) AS numbers,
           md5(regexp_replace(text, '[0-9]', '#')) AS masked, CAST(size(regexp_extract_all(text, '[A-Z][a-z]+', 0)) AS BIGINT) AS capitals FROM documents""", r"""
    SELECT doc_id, regexp_extract(text, '([A-Za-z]+)ing', 1) AS stem, len(regexp_extract_all(text, '[0-9]+')) AS numbers,
           md5(regexp_replace(text, '[0-9]', '#', 'g')) AS masked, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS capitals FROM documents""")
sql_query("fn_hash", "documents", "SELECT doc_id, md5(text) AS m, sha2(text, 256) AS s FROM documents", "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")
sql_query("fn_datetime", "orders", """
    SELECT o_orderkey, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS m, CAST(last_day(o_orderdate) AS DATE) AS ld, CAST(datediff(DATE '2002-01-01', o_orderdate) AS BIGINT) AS dd,
           date_format(o_orderdate, 'yyyy-MM') AS ym, CAST(extract(WEEK FROM o_orderdate) AS BIGINT) AS wk, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS yr,
           CAST(dayofweek(o_orderdate) AS BIGINT) AS dow, date_add(CAST(o_orderdate AS DATE), 30) AS later FROM orders""", """
    SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS m, last_day(o_orderdate) AS ld, date_diff('day', o_orderdate::DATE, DATE '2002-01-01') AS dd,
           strftime(o_orderdate, '%Y-%m') AS ym, extract(week FROM o_orderdate) AS wk, extract(year FROM o_orderdate) AS yr,
           dayofweek(o_orderdate) + 1 AS dow, o_orderdate::DATE + 30 AS later FROM orders""")
sql_query("fn_math", "lineitem", """
    SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 1) AS r, bround(l_quantity / 4, 1) AS br, CAST(l_orderkey % 7 AS BIGINT) AS md, round(sqrt(l_extendedprice), 6) AS sq,
           round(ln(l_extendedprice), 6) AS lg, greatest(l_discount, l_tax) AS g, least(l_discount, l_tax) AS le, abs(l_tax - l_discount) AS ab, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS fl FROM lineitem""", """
    SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 1) AS r, round_even(l_quantity / 4, 1) AS br, l_orderkey % 7 AS md, round(sqrt(l_extendedprice), 6) AS sq,
           round(ln(l_extendedprice), 6) AS lg, greatest(l_discount, l_tax) AS g, least(l_discount, l_tax) AS le, abs(l_tax - l_discount) AS ab, floor(l_extendedprice / 1000)::BIGINT AS fl FROM lineitem""")
sql_query("fn_cast", "part", """
    SELECT p_partkey, try_cast(p_name AS INT) AS bad, try_cast(concat(p_size, '') AS INT) AS good, CAST(p_retailprice AS DECIMAL(12,2)) AS price, CAST(floor(p_retailprice) AS INT) AS whole FROM part""", """
    SELECT p_partkey, try_cast(p_name AS INT) AS bad, try_cast(concat(p_size, '') AS INT) AS good, p_retailprice::DECIMAL(12,2) AS price, floor(p_retailprice)::INT AS whole FROM part""")
sql_query("fn_array", "embeddings", """
    SELECT vec_id, size(embedding) AS n, round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), 0D, (s, x) -> s + x), 6) AS sq,
           size(filter(embedding, x -> x > 0)) AS positive, exists(embedding, x -> x > 0.4) AS any_big, forall(embedding, x -> x > -1.1) AS all_small,
           size(array_distinct(transform(embedding, x -> x > 0))) AS signs, size(slice(embedding, 1, 8)) AS head, size(flatten(array(embedding, embedding))) AS twice FROM embeddings""", """
    SELECT vec_id, len(embedding)::INT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS sq,
           len(list_filter(embedding, lambda x: x > 0))::INT AS positive, len(list_filter(embedding, lambda x: x > 0.4::DOUBLE)) > 0 AS any_big, len(list_filter(embedding, lambda x: x > -1.1)) = len(embedding) AS all_small,
           len(list_distinct(list_transform(embedding, lambda x: x > 0)))::INT AS signs, len(embedding[1:8])::INT AS head, len(flatten([embedding, embedding]))::INT AS twice FROM embeddings""")
sql_query("fn_explode", "embeddings", "SELECT vec_id, pos, CAST(col AS DOUBLE) AS v FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, col",
          "SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings")
sql_query("fn_map_struct", "nation", """
    SELECT n_nationkey, map_from_arrays(array('name', 'region'), array(n_name, CAST(n_regionkey AS STRING)))['name'] AS v,
           size(map_filter(map('a', n_nationkey, 'b', n_regionkey), (k, v) -> v > 2)) AS n, array_join(array_sort(map_keys(map('b', 1, 'a', 2))), ',') AS ks,
           named_struct('k', n_nationkey, 'name', n_name).name AS f, element_at(transform_values(map('x', n_nationkey), (k, v) -> v * 2), 'x') AS tv FROM nation""", """
    SELECT n_nationkey, n_name AS v, (n_nationkey > 2)::INT + (n_regionkey > 2)::INT AS n, 'a,b' AS ks, n_name AS f, n_nationkey * 2 AS tv FROM nation""")
sql_query("fn_json", "events", """
    SELECT event_id, get_json_object(props, '$.k') AS k, from_json(props, 'k INT').k AS n, to_json(named_struct('u', user_id)) AS j, variant_get(parse_json(props), '$.k', 'int') AS v FROM events""", """
    SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract(props, '$.k')::INT AS n, '{"u":' || user_id || '}' AS j, json_extract(props, '$.k')::INT AS v FROM events""")
sql_query("fn_url", "pages", """
    SELECT page_id, try_parse_url(url, 'HOST') AS host, try_parse_url(url, 'QUERY') AS q, url_decode(url_encode(url)) = url AS back FROM pages""", """
    SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) AS host, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS q, true AS back FROM pages""".replace("\\\\", "\\"))
sql_query("fn_more_string", "customer", """
    SELECT c_custkey, initcap(lower(c_mktsegment)) AS title, left(c_name, 4) AS l4, right(c_name, 3) AS r3, startswith(c_name, 'Cust') AS sw, contains(c_name, '#') AS has,
           position('#' IN c_name) AS p, lower(hex(c_mktsegment)) AS hx, base64(CAST(c_mktsegment AS BINARY)) AS b64, ltrim('0', split(c_name, '#')[1]) AS num, overlay(c_mktsegment PLACING 'X' FROM 2 FOR 1) AS ov FROM customer""", """
    SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS title, left(c_name, 4) AS l4, right(c_name, 3) AS r3, starts_with(c_name, 'Cust') AS sw, contains(c_name, '#') AS has,
           instr(c_name, '#')::INT AS p, lower(hex(c_mktsegment)) AS hx, base64(c_mktsegment::BLOB) AS b64, ltrim(split_part(c_name, '#', 2), '0') AS num, c_mktsegment[1] || 'X' || c_mktsegment[3:] AS ov FROM customer""")
sql_query("fn_more_math", "part", """
    SELECT p_partkey, CAST(width_bucket(p_retailprice, 900, 2000, 11) AS BIGINT) AS wb, sign(p_retailprice - 1000) AS sg, round(log10(p_retailprice), 6) AS l10, round(exp(p_size / 50.0D), 6) AS ex,
           round(pow(p_size, 1.5), 6) AS pw, ceil(p_retailprice) AS ce, p_size & 7 AS ba, p_size ^ 3 AS bx, hypot(p_size, 2) > 2 AS hy, pmod(-p_size, 7) AS pm FROM part""", """
    SELECT p_partkey, (CASE WHEN p_retailprice < 900 THEN 0 WHEN p_retailprice >= 2000 THEN 12 ELSE floor((p_retailprice - 900) / 100) + 1 END)::BIGINT AS wb, sign(p_retailprice - 1000)::DOUBLE AS sg,
           round(log10(p_retailprice), 6) AS l10, round(exp(p_size / 50.0::DOUBLE), 6) AS ex, round(pow(p_size, 1.5), 6) AS pw, ceil(p_retailprice)::BIGINT AS ce, p_size & 7 AS ba, xor(p_size, 3) AS bx,
           sqrt(p_size * p_size + 4) > 2 AS hy, ((-p_size % 7) + 7) % 7 AS pm FROM part""")
sql_query("fn_more_datetime", "events", """
    SELECT event_id, CAST(hour(ts) AS BIGINT) AS h, CAST(quarter(ts) AS BIGINT) AS q, CAST(dayofyear(ts) AS BIGINT) AS doy, add_months(CAST(ts AS DATE), 1) AS am, make_date(2024, 2, 29) AS md,
           CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ) AS th, next_day(CAST(ts AS DATE), 'MON') AS nd, to_date(date_format(ts, 'yyyyMMdd'), 'yyyyMMdd') AS td FROM events""", """
    SELECT event_id, hour(ts) AS h, quarter(ts) AS q, dayofyear(ts) AS doy, (ts::DATE + INTERVAL 1 MONTH)::DATE AS am, make_date(2024, 2, 29) AS md,
           date_trunc('hour', ts) AS th, ts::DATE + (8 - isodow(ts))::INT AS nd, ts::DATE AS td FROM events""")
sql_query("fn_more_array", "nation", """
    SELECT n_regionkey, array_sort(collect_set(n_nationkey)) AS ks, array_max(collect_list(n_nationkey)) AS mx, array_contains(collect_list(n_nationkey), 5) AS has5,
           size(array_union(collect_list(n_nationkey), array(1, 2, 99))) AS u, array_position(array_sort(collect_list(n_nationkey)), max(n_nationkey)) AS pos,
           aggregate(zip_with(array_sort(collect_list(n_nationkey)), sequence(1, 5), (a, b) -> a * b), 0, (s, x) -> s + x) AS dot FROM nation GROUP BY n_regionkey""", """
    SELECT n_regionkey, list_sort(list(n_nationkey)) AS ks, max(n_nationkey) AS mx, list_contains(list(n_nationkey), 5) AS has5,
           len(list_distinct(list_concat(list(n_nationkey), [1, 2, 99])))::INT AS u, list_position(list_sort(list(n_nationkey)), max(n_nationkey))::BIGINT AS pos,
           list_sum(list_transform(list_zip(list_sort(list(n_nationkey)), range(1, 6)), lambda p: p[1] * p[2]))::INT AS dot FROM nation GROUP BY n_regionkey""")

# fixed values: results that the Spark documentation states, for functions that the other engine lacks
sql_query("fn_spark_only", "region", """
    SELECT r_regionkey, soundex('Miller') AS sx, crc32('Spark') AS crc, xxhash64('Spark', array(123), 2) AS xx, months_between('1997-02-28 10:30:00', '1996-10-30') AS mb,
           j.c0 AS ja, j.c1 AS jb FROM region LATERAL VIEW json_tuple('{"a":1, "b":2}', 'a', 'b') j AS c0, c1""",
          "SELECT r_regionkey, 'M460' AS sx, 1557323817::BIGINT AS crc, 5602566077635097486 AS xx, 3.94959677::DOUBLE AS mb, '1' AS ja, '2' AS jb FROM region")
