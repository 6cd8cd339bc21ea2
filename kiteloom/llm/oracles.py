"""Oracle SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from kiteloom.llm.quality_rules import RULES, STOP_WORDS
from kiteloom.llm.url_filters import RULES as URL_RULES
from kiteloom.llm.url_filters import TWO_LABEL_SUFFIXES, Z

#: Runs of characters outside the six word separators, as a list.
_WORDS = "regexp_extract_all(coalesce({}, ''), '[^\\x20\\x09-\\x0D]+')"


def _count(chars: str) -> str:
    return f"length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{chars}', ''))"


def _quality() -> str:
    cases = [f"CASE WHEN {r.numerator} {r.op} {float(r.limit)!r}::DOUBLE * {r.denominator or 1} THEN '{r.name}' END" for r in RULES]
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
    WITH d AS (SELECT doc_id, text, {_WORDS.format('text')} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
    win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
    rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM twice, range(3) t(k)) GROUP BY doc_id),
    m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, {_count('#*$%&|<>')} AS n_symbols,
        {_count('!')} AS n_marks, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*•]'))) AS n_bullet_lines,
        len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09\\r]*$'))) AS n_ellipsis_lines,
        len(list_filter(list_distinct(w), lambda x: x IN ({stop}))) AS n_stop_words, coalesce(rep.n, 0) AS n_repeat_words
        FROM d LEFT JOIN rep USING (doc_id)),
    j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL) AS failed_rules FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(failed_rules) = 0 AS kept, failed_rules FROM j
    """


_SUBSTRINGS = f"""
    WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
    win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
    cut AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE least < doc_id),
    gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM cut) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
        sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, n: NOT list_contains(gone, n)) END, ' ')) AS kept_sha256
    FROM d LEFT JOIN gone USING (doc_id)
    """

_ESCAPED = "replace(replace(replace(replace(replace(replace(replace({}, '\\', '\\\\'), '</s>', '\\e'), '<s>', '\\b'), '[/INST]', '\\c'), '[INST]', '\\o'), '<<SYS>>', '\\y'), '<</SYS>>', '\\z')"
_CHAT = f"""
    WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, md5(text))) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, md5(text)) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(length('<s>[INST][/INST]</s>') + 1 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id
    """

_NEAR = f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
        UNION SELECT doc_id, md5(array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 2),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.node)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.low AS component_id, m.low = d.doc_id AS kept
    FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(low) AS low FROM r GROUP BY node) m ON m.node = d.doc_id
    """


def _urls(z: float = Z, least: float = 2.0, most: float = 200.0) -> str:
    suffixes = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
    ordered = sorted(URL_RULES, key=lambda r: (-len(r.rule), r.rule))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r.rule}'" for f, r in zip(fits, ordered, strict=True)) + " END"
    told = "CASE rule " + " ".join(f"WHEN '{r.rule}' THEN '{r.verdict}'" for r in ordered) + " END"

    def strength(groups: str) -> str:
        return f"""(SELECT least(greatest(coalesce(CASE WHEN k > 1 AND n > k AND n * n > nn THEN CASE WHEN between_ > 0 THEN p * (1 - p) / between_ - 1 ELSE {most} END END, {least}), {least}), {most}) FROM
            (SELECT *, (sq - n * p * p - (k - 1) * p * (1 - p)) / (n - nn / n) AS between_ FROM (SELECT count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE / sum(n) AS p, sum(n * (bad / n::DOUBLE) * (bad / n::DOUBLE)) AS sq, sum(n * n)::DOUBLE AS nn FROM {groups} WHERE n > 0)))"""

    return f"""
    WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    o AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
    h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM p LEFT JOIN o USING (page_id) GROUP BY host),
    h1 AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name FROM h0),
    h2 AS (SELECT *, CASE WHEN array_to_string(string_split(name, '.')[-2:], '.') IN ({suffixes}) THEN array_to_string(string_split(name, '.')[-2:], '.') ELSE string_split(name, '.')[-1] END AS suffix FROM h1),
    h AS (SELECT *, CASE WHEN length(name) <= length(suffix) THEN name ELSE string_split(name[:length(name) - length(suffix) - 1], '.')[-1] || '.' || suffix END AS domain FROM h2),
    d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY 1),
    a AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2)::DOUBLE AS mean FROM s),
    ks AS (SELECT {strength('s')} AS k), kd AS (SELECT {strength('d')} AS k), kh AS (SELECT {strength('h')} AS k),
    ps AS (SELECT suffix, (mean * k + bad) / (k + n) AS mean FROM s, a, ks), pd AS (SELECT domain, (ps.mean * k + bad) / (k + n) AS mean FROM d JOIN ps USING (suffix), kd),
    ph AS (SELECT host, (pd.mean * k + bad) / (k + n) AS post_mean, k + n AS total FROM h JOIN pd USING (domain), kh),
    v AS (SELECT p.*, {rule} AS rule, post_mean, greatest(post_mean - {z} * sqrt(post_mean * (1 - post_mean) / (total + 1)), 0.0) AS lower_bound FROM p JOIN ph USING (host))
    SELECT page_id, host, path, rule, coalesce({told}, CASE WHEN lower_bound > a.mean THEN 'block' ELSE 'allow' END) AS verdict,
        round(post_mean, 6) AS post_mean, round(lower_bound, 6) AS lower_bound FROM v, a
    """


#: crc32 of a number in decimal, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
        lambda acc, x: list_reduce(list_prepend(xor(acc, x), range(8)::UBIGINT[]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END)), 4294967295::UBIGINT)"""
_TRIE = f"""
    WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, CAST({_CRC.format('conv_id')} % 4 AS BIGINT) AS h, conv_id - conv_id % 20 AS base, n FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id)),
    r0 AS (SELECT c.conv_id, 0 AS part, o.i, o.role, o.text FROM c JOIN o ON o.conv_id = c.base WHERE o.i < c.h
        UNION ALL SELECT c.conv_id, 1, o.i, o.role, o.text FROM c JOIN o USING (conv_id) WHERE o.i >= c.h),
    r1 AS (SELECT conv_id, row_number() OVER w AS d, string_agg(md5(length(role) || ' ' || role || text), '') OVER (w ROWS UNBOUNDED PRECEDING) AS path, len({_WORDS.format('text')}) AS words
        FROM r0 WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)),
    r AS (SELECT conv_id, d, md5(path) AS k, words FROM r1 UNION ALL SELECT conv_id, 0, '', 0 FROM c),
    n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM r GROUP BY d, k),
    l AS (SELECT conv_id, max(d) AS len FROM r GROUP BY conv_id),
    e AS (SELECT r.d, r.k, sha256(string_agg(CAST(r.conv_id AS VARCHAR), ',' ORDER BY r.conv_id)) AS ends FROM r JOIN l ON l.conv_id = r.conv_id AND l.len = r.d GROUP BY r.d, r.k),
    up AS (SELECT n.*, p.k AS up_k FROM n LEFT JOIN r p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
    kids AS (SELECT d - 1 AS d, up_k AS k, count(*) AS n_children FROM up WHERE d > 0 GROUP BY 1, 2),
    own AS (SELECT up.*, coalesce(kids.n_children, 0) AS n_children FROM up LEFT JOIN kids USING (d, k)),
    below AS (SELECT a.d, a.k, sum(CASE WHEN own.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((own.n_convs - 1) * own.words) AS saved FROM own JOIN r a ON a.conv_id = own.conv_id AND a.d <= own.d GROUP BY a.d, a.k)
    SELECT own.conv_id, CAST(own.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, own.n_convs, own.n_children, CAST(below.n_leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens,
        coalesce(e.ends, sha256('')) AS ends_sha256
    FROM own JOIN below USING (d, k) LEFT JOIN n p ON p.d = own.d - 1 AND p.k = own.up_k LEFT JOIN e ON e.d = own.d AND e.k = own.k
    """


def _merkle() -> str:
    """Both trees level by level, the lang trees and the tree of their subroots, to a height of 40."""

    def item(c: str) -> str:
        return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"

    leaf = " || ".join(item(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    changed = " || ".join(item(c) for c in ("doc_id", "source", "lang", "n_chars + 1", "text"))
    # nodes of a tree: its key, level, place and digest; a tree with one node has ended
    up = """SELECT tree, level + 1 AS level, pos // 2 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, (any_value(n) + 1) // 2 AS n FROM {t} WHERE n > 1 GROUP BY tree, level, pos // 2"""
    # a proof goes up from level to level: what it holds, and the digest folded so far
    climb = """SELECT p.{key}, p.tree, p.level + 1, p.pos // 2 AS pos, p.proof || coalesce(s.h, ''),
            sha256(CASE WHEN p.pos % 2 = 1 THEN coalesce(s.h, '') || p.h ELSE p.h || coalesce(s.h, '') END), (p.n + 1) // 2
            FROM {p} p LEFT JOIN {t} s ON s.tree = p.tree AND s.level = p.level AND s.pos = (CASE WHEN p.pos % 2 = 0 THEN p.pos + 1 ELSE p.pos - 1 END) WHERE p.n > 1"""
    return f"""
    WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM
        (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({leaf}) AS leaf, sha256({changed}) AS changed FROM documents)),
    crc AS (SELECT doc_id, {_CRC.format('doc_id')} AS crc FROM (SELECT DISTINCT doc_id FROM documents)),
    t AS (SELECT tree, 0 AS level, pos, leaf AS h, n FROM d UNION ALL {up.format(t="t")}),
    s AS (SELECT tree AS lang_tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
    u AS (SELECT '' AS tree, 0 AS level, pos, h, n FROM s UNION ALL {up.format(t="u")}),
    root AS (SELECT h AS root FROM u WHERE n = 1),
    p AS (SELECT doc_id, tree, 0 AS level, pos, '' AS proof, CASE WHEN crc % 7 = 0 AND changed IS NOT NULL THEN changed ELSE leaf END AS h, n FROM d JOIN crc USING (doc_id)
        UNION ALL {climb.format(key="doc_id", p="p", t="t")}),
    q AS (SELECT p.doc_id, '' AS tree, 0 AS level, s.pos, p.proof, p.h, s.n FROM p JOIN s ON s.lang_tree = p.tree WHERE p.n = 1
        UNION ALL {climb.format(key="doc_id", p="q", t="u")})
    SELECT d.doc_id, d.leaf, s.h AS subroot, root, sha256(q.proof) AS proof_sha256, q.h AS folded_root, q.h = root AS verified
    FROM d JOIN q USING (doc_id) JOIN s ON s.lang_tree = d.tree, root WHERE q.n = 1
    """


ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": _quality(),
    "op4_substring_dedup": _SUBSTRINGS,
    "op5_chat_formatting": _CHAT,
    "op6_minhash_near_dedup": _NEAR,
    "op8_url_filters": _urls(),
    "op12_merkle_manifest": _merkle(),
    "op13_prefix_trie": _TRIE,
}
