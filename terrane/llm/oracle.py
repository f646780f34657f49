"""DuckDB SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

from terrane.llm import audio_media, chat_tree, license_scan, mixing
from terrane.llm.decontaminate import WINDOW

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def license_sql() -> str:
    def places(phrase: str) -> str:
        equal = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        return f"list_filter(range(1, len(w) + 1), lambda i: {equal})"

    phrases = list(license_scan.PHRASES.items())
    marks = ", ".join(f"{places(p)} AS p{k}" for k, (p, _) in enumerate(phrases))
    every = "list_concat(" * (len(phrases) - 1) + "p0" + "".join(f", p{k})" for k in range(1, len(phrases)))
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(phrases))
    more = ", ".join(f"CASE WHEN regexp_matches(joined, ' {license_scan.pattern(t)}') THEN '{label}' END" for label, t in license_scan.TEMPLATES.items())
    labels = lambda x: f"array_to_string(list_sort(list_distinct(list_filter({x}, lambda v: v IS NOT NULL))), ',')"
    return f"""WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 found AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS joined, {marks} FROM words),
 named AS (SELECT doc_id, len(w) AS n_words, {every} AS p, [{base}] AS b, [{more}] AS m FROM found)
 SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(p) - 1 AS BIGINT) AS first_word, CAST(list_max(p) - 1 AS BIGINT) AS last_word,
 {labels('b')} AS base_labels, {labels('list_concat(b, m)')} AS labels,
 CASE WHEN len(list_filter(m, lambda v: v IS NOT NULL)) > 0 THEN 1.0::DOUBLE WHEN len(p) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM named"""


def decontamination_sql(width: int = WINDOW) -> str:
    """The longest match is the longest row of windows on one diagonal."""
    return f"""WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
 spot AS (SELECT item, w, least(len(w), {width}) AS size, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS q FROM item WHERE len(w) > 0),
 win AS (SELECT DISTINCT item, q, size, array_to_string(w[q : q + size - 1], ' ') AS win FROM spot),
 doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 place AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM doc, (SELECT DISTINCT size FROM win) WHERE len(w) >= size),
 hit AS (SELECT doc_id, p, h.size, item, q FROM (SELECT doc_id, p, size, array_to_string(w[p : p + size - 1], ' ') AS win FROM place) h JOIN win ON win.win = h.win AND win.size = h.size),
 words AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS spot FROM hit) GROUP BY doc_id),
 items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id),
 line AS (SELECT doc_id, p, max(p) OVER (PARTITION BY doc_id, item, q - p, run) - p + size AS size FROM
  (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item, q - p ORDER BY p) AS run FROM hit)),
 longest AS (SELECT doc_id, max(size) AS longest_match FROM line GROUP BY doc_id)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest_match, 0) AS BIGINT) AS longest_match
 FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)"""


def chat_sql() -> str:
    def escaped(x: str) -> str:
        x = f"replace({x}, '\\', '\\\\')"
        for c in chat_tree.CONTROL:
            x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
        return x

    planted = ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in chat_tree.PLANTED)
    around = len(chat_tree.TURN) + len(chat_tree.END) + 2
    return f"""WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
  CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {planted}) AS v(conv_id, turn, role, text))),
 whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum({around} + length(replace({escaped('role')}, chr(10), '\\N')) + length({escaped('text')})) AS formatted FROM rows GROUP BY conv_id, lone)
 SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
 CAST(formatted AS BIGINT) AS formatted_chars FROM whole"""


def repeats_sql(width: int = 100) -> str:
    """All strings of ``width`` bytes, by their MD5, in order of document and start; each byte as two hexadecimal digits."""
    return f"""WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 sized AS (SELECT doc_id, h, length(h) // 2 AS n FROM doc),
 part AS (SELECT doc_id, base, substr(h, 2 * base + 1, {2 * (200 + width - 1)}) AS h FROM (SELECT doc_id, h, unnest(range(0, n, 200)) AS base FROM sized)),
 start AS (SELECT doc_id, h, base, unnest(range(0, least(200, length(h) // 2 - {width - 1}))) AS i FROM part WHERE length(h) >= {2 * width}),
 string AS (SELECT doc_id, base + i AS p, md5(substr(h, 2 * i + 1, {2 * width})) AS k FROM start),
 later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS i FROM string) WHERE i > 1),
 opened AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {width} THEN 0 ELSE 1 END AS new FROM later),
 numbered AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM opened),
 span AS (SELECT doc_id, min(p) AS a, max(p) + {width} AS b FROM numbered GROUP BY doc_id, run),
 per AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id),
 gap AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM span UNION ALL SELECT doc_id, max(b), NULL FROM span GROUP BY doc_id),
 kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS kept FROM gap JOIN sized USING (doc_id) GROUP BY doc_id)
 SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM sized LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def media_sql() -> str:
    """Payload, file and checksum as hexadecimal digits; spectra as products with rows of cosines and sines."""
    frame, hop, ahead, peaks = audio_media.FRAME, audio_media.HOP, audio_media.AHEAD, audio_media.PEAKS
    size = lambda v: "printf('%02x%02x%02x%02x', " + ", ".join(f"({v} >> {b}) & 255" for b in (0, 8, 16, 24)) + ")"
    head = f"'52494646' || {size('(m + 36)')} || '57415645666d74201000000001000100401f0000401f00000100080064617461' || {size('m')}"
    wave = lambda f: f"list_transform(range(0, {frame}), lambda k: {f}(2 * pi() * j * k / {frame}))"
    return f"""WITH doc AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
 sized AS (SELECT doc_id, h, length(h) // 2 AS n, greatest(1, (length(h) // 2 + 191) // 192) * 192 AS m FROM doc),
 stored AS (SELECT doc_id, n, m, h || repeat('20', m - n) AS p FROM sized),
 tail AS (SELECT doc_id, list_reduce(list_prepend(4294967295, list_transform(range(0, 16), lambda i: CAST('0x' || substr(p, 2 * m - 31 + 2 * i, 2) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS c FROM stored),
 frame AS (SELECT doc_id, t, substr(p, {2 * hop} * t + 1, {2 * frame}) AS x FROM (SELECT doc_id, p, unnest(range(0, (m - {frame}) // {hop} + 1)) AS t FROM stored)),
 sample AS (SELECT doc_id, t, list_transform(range(0, {frame}), lambda k: (CAST('0x' || substr(x, 2 * k + 1, 2) AS INTEGER) - 128) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * k / {frame - 1}))) AS v FROM frame),
 bin AS (SELECT j, {wave('cos')} AS c, {wave('sin')} AS s FROM (SELECT unnest(range(2, {frame // 2 + 1})) AS j)),
 power AS (SELECT doc_id, t, j, round(sqrt(pow(list_inner_product(v, c), 2) + pow(list_inner_product(v, s), 2)), 3) AS p FROM sample, bin),
 near AS (SELECT *, coalesce(lag(p) OVER spectrum, 0) AS low, lead(p) OVER spectrum AS high FROM power WINDOW spectrum AS (PARTITION BY doc_id, t ORDER BY j)),
 top AS (SELECT doc_id, t, j, row_number() OVER (PARTITION BY doc_id, t ORDER BY p DESC, j) AS k FROM near WHERE p > 0 AND p >= low AND p > high),
 pair AS (SELECT a.doc_id, (a.t << 32) | (a.j << 20) | (b.j << 8) | (b.t - a.t) AS code, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.t, b.t, a.k, b.k) AS i
  FROM top a JOIN top b ON a.doc_id = b.doc_id AND b.t BETWEEN a.t + 1 AND a.t + {ahead} WHERE a.k <= {peaks} AND b.k <= {peaks}),
 told AS (SELECT doc_id, count(*) AS pairs, md5(string_agg(CAST(code AS VARCHAR), ',' ORDER BY i)) AS all_codes, min(code) FILTER (i = 1) & 4294967295 AS one FROM pair GROUP BY doc_id)
 SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, sha256(unhex(p)) AS payload_sha256, CAST(xor(c, 4294967295) AS BIGINT) AS tail_crc32,
 CAST(m + 44 AS BIGINT) AS media_bytes, sha256(unhex({head} || p)) AS media_sha256,
 CAST(coalesce(pairs, 0) AS VARCHAR) || ':' || coalesce(all_codes, md5('')) || ':' || printf('%x', coalesce(one, 0)) AS feature
 FROM stored JOIN tail USING (doc_id) LEFT JOIN told USING (doc_id)"""


def mixing_sql() -> str:
    """The rule of the targets, the draw of the shards, the permutations and the packing, step by step."""
    block, shard_slots, bucket_rows, most = mixing.BLOCK_WORDS, mixing.SHARD_SLOTS, mixing.BUCKET_ROWS, mixing.MOST_REPEATS
    hashed = lambda *parts: f"CAST('0x' || substr(md5(concat_ws(',', {', '.join(parts)})), 1, 15) AS BIGINT)"

    def walk(name: str, source: str, ids: str, x: str, n: str, *key: str) -> str:
        """Permutes x below n; rows of ``source`` that are out of range go round again."""
        def once(v: str, rows: str, where: str) -> str:
            rounds = ", ".join(f"(l{k} + {hashed(f'l{k + 1}', str(k), *key)} % side) % side AS l{k + 2}" for k in range(4))
            return f"""SELECT {ids}, n, l4 * side + l5 AS v FROM (SELECT *, CAST(floor(sqrt(CAST(n AS DOUBLE))) AS BIGINT) + 1 AS side, {v} // side AS l0, {v} % side AS l1, {rounds} FROM {rows} {where})"""

        return f"""{name} AS ({once('x', f'(SELECT *, CAST({x} AS BIGINT) AS x, CAST({n} AS BIGINT) AS n FROM {source})', '')} UNION ALL {once('v', name, 'WHERE v >= n')})"""

    goal = f"""weighed AS (SELECT *, CAST([5, 2, 1][nth % 3 + 1] AS DOUBLE) AS weight, source_size * {most}.0::DOUBLE AS cap FROM
  (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM sized GROUP BY source)),
 levelled AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
 per AS (SELECT source, nth, source_size, least(cap, weight * coalesce((SELECT level FROM levelled WHERE level * weight <= cap ORDER BY cap / weight, nth LIMIT 1), 0)) AS target FROM levelled),
 full_passes AS (SELECT *, CAST(ceil(source_size / {block}) AS BIGINT) AS blocks, source_size % {block} AS tail, least(CAST(round(target) AS BIGINT), source_size * {most}) AS goal,
  goal // source_size AS passes, goal % source_size AS rest FROM per WHERE source_size > 0),
 turned AS (SELECT *, CASE WHEN tail > 0 THEN {hashed('nth', 'passes', '0', "'tail'")} % blocks ELSE blocks END AS turn FROM full_passes),
 slotted AS (SELECT *, passes * blocks + CAST(CASE WHEN rest <= turn * {block} THEN ceil(rest / {block}) WHEN rest <= turn * {block} + tail THEN turn + 1
  ELSE turn + 1 + ceil((rest - turn * {block} - tail) / {block}) END AS BIGINT) AS slots FROM turned),
 goal AS (SELECT *, sum(slots) OVER (ORDER BY nth) - slots AS base, sum(slots) OVER () AS all_slots FROM slotted WHERE slots > 0)"""
    return f"""WITH RECURSIVE sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) AS BIGINT) AS size FROM documents),
 {goal},
 slot AS (SELECT nth, base, all_slots, unnest(range(0, CAST(slots AS BIGINT))) AS i FROM goal),
 {walk('drawn_place', 'slot', 'nth', 'base + i', 'all_slots', '0', "'slots'")},
 counted AS (SELECT v // {shard_slots} AS shard, nth, count(*) AS count FROM drawn_place WHERE v < n GROUP BY ALL),
 dealt AS (SELECT shard, nth, CAST(sum(count) OVER (PARTITION BY nth ORDER BY shard) - count AS BIGINT) AS before, count FROM counted),
 each_slot AS (SELECT shard, nth, before + unnest(range(0, count)) AS i FROM dealt),
 timed AS (SELECT e.*, blocks, tail, passes, rest, i // blocks AS pass, i % blocks AS at_block, CASE WHEN i // blocks < passes THEN CASE WHEN tail > 0 THEN blocks - 1 ELSE blocks END ELSE turn END AS turned
  FROM each_slot e JOIN goal USING (nth)),
 {walk('placed_block', '(SELECT * FROM timed WHERE at_block <> turned)', 'nth, pass, i', 'at_block - CASE WHEN at_block > turned THEN 1 ELSE 0 END', 'greatest(blocks - CASE WHEN tail > 0 THEN 1 ELSE 0 END, 1)', 'nth', 'pass', '0')},
 taking AS (SELECT shard, nth, CASE WHEN at_block = turned THEN blocks - 1 ELSE v END AS index, CASE WHEN at_block = turned THEN tail ELSE {block} END AS length,
  CASE WHEN pass < passes THEN CASE WHEN at_block = turned THEN tail ELSE {block} END ELSE least(CASE WHEN at_block = turned THEN tail ELSE {block} END,
   rest - (at_block * {block} - CASE WHEN at_block > turned THEN {block} - tail ELSE 0 END)) END AS words
  FROM timed LEFT JOIN (SELECT nth, pass, i, v FROM placed_block WHERE v < n) USING (nth, pass, i)),
 drawn AS (SELECT nth, index, count(*) FILTER (words = length) AS times, min(shard) FILTER (words = length) AS shard, coalesce(max(words) FILTER (words < length), 0) AS part,
  min(shard) FILTER (words < length) AS part_shard FROM taking GROUP BY ALL),
 bucketed AS (SELECT doc_id, size, nth, source_size, target, {hashed('doc_id', 'size', '0')} % (SELECT greatest(1, CAST(ceil(count(*) / greatest({bucket_rows}, floor(sqrt(count(*))))) AS BIGINT)) FROM sized) AS bucket
  FROM sized JOIN per ON per.source IS NOT DISTINCT FROM sized.source),
 packed AS (SELECT *, CAST(sum(size) OVER (PARTITION BY nth ORDER BY bucket, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS first FROM bucketed),
 piece AS (SELECT nth, first, doc_id, size, source_size, target, unnest(range(first // {block}, greatest(first, first + size - 1) // {block} + 1)) AS index FROM packed),
 cut AS (SELECT *, greatest(first - index * {block}, 0) AS a, least(first + size - index * {block}, {block}) AS b FROM piece),
 joined AS (SELECT c.*, times, part, shard, part_shard, greatest(least(b, part) - a, 0) AS partly FROM cut c LEFT JOIN drawn d ON d.nth = c.nth AND d.index = c.index)
 SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN sum(coalesce(times * (b - a) + partly, 0)) ELSE 0 END AS BIGINT) AS taken,
 CAST(CASE WHEN size > 0 THEN sum(coalesce(times + CASE WHEN partly > 0 THEN 1 ELSE 0 END, 0)) ELSE 0 END AS BIGINT) AS slots,
 CASE WHEN size > 0 THEN min(least(shard, CASE WHEN partly > 0 THEN part_shard END)) END AS first_shard
 FROM joined GROUP BY nth, first, doc_id, size, source_size, target"""


#: The five primes of XXH64, and two to the power of 64.
_P1, _P2, _P3, _P4, _P5, _WHOLE = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261, 2**64


def xxh64_sql(table: str, x: str = "x", seed: int = 42) -> str:
    """SQL of CTEs that end in ``xx_hashed`` (x, h): the XXH64 of each distinct string of ``table``, as UHUGEINT below 2**64.

    Numbers of 128 bits hold a product of two of 64; what is above 64 bits is taken off with the remainder.
    """
    whole = f"{_WHOLE}::UHUGEINT"
    times = lambda a, b: f"(({a}) * {b}::UHUGEINT % {whole})"
    let = lambda value, name, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    turn = lambda v, n: f"({v} * {2**n}::UHUGEINT % {whole} + {v} // {2 ** (64 - n)}::UHUGEINT)"
    stir = lambda acc, lane: let(f"({acc} + {times(lane, _P2)}) % {whole}", "y", times(turn("y", 31), _P1))
    number = lambda at, n: "CAST('0x' || " + " || ".join(f"substr(hex_x, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(n))) + " AS UBIGINT)::UHUGEINT"
    lanes = lambda j: f"list_transform(range(0, bytes // 32), lambda i: {number(f'32 * i + {8 * j}', 8)})"
    starts = [(seed + _P1 + _P2) % _WHOLE, (seed + _P2) % _WHOLE, seed, (seed - _P1) % _WHOLE]
    accs = ", ".join(f"list_reduce(list_prepend({v}::UHUGEINT, {lanes(j)}), lambda acc, lane: {stir('acc', 'lane')}) AS a{j}" for j, v in enumerate(starts))
    merged = f"({' + '.join(turn(f'a{j}', n) for j, n in enumerate((1, 7, 12, 18)))}) % {whole}"
    mixed = f"list_reduce([{merged}, a0, a1, a2, a3], lambda h, lane: ({times('xor(h, ' + stir('0::UHUGEINT', 'lane') + ')', _P1)} + {_P4}) % {whole})"
    done = "(bytes // 32 * 32)"
    eights = f"list_transform(range(0, bytes % 32 // 8), lambda i: {number(f'{done} + 8 * i', 8)})"
    by_eights = f"list_reduce(list_prepend(h, {eights}), lambda h, lane: ({times(let('xor(h, ' + stir('0::UHUGEINT', 'lane') + ')', 'z', turn('z', 27)), _P1)} + {_P4}) % {whole})"
    four = let(f"xor(h, {times(number('bytes // 8 * 8', 4), _P1)})", "z", f"({times(turn('z', 23), _P2)} + {_P3}) % {whole}")
    ones = f"list_transform(range(bytes // 4 * 4, bytes), lambda i: {number('i', 1)})"
    by_ones = f"list_reduce(list_prepend(h, {ones}), lambda h, lane: {times(let('xor(h, ' + times('lane', _P5) + ')', 'z', turn('z', 11)), _P1)})"
    last = lambda v, n: f"xor({v}, {v} // {2**n}::UHUGEINT)"
    return f"""xx_text AS (SELECT DISTINCT {x} AS x, hex(encode({x})) AS hex_x, CAST(strlen({x}) AS BIGINT) AS bytes FROM {table}),
 xx_stripes AS (SELECT x, hex_x, bytes, {accs} FROM xx_text WHERE bytes >= 32),
 xx_begun AS (SELECT x, hex_x, bytes, ({mixed} + bytes::UHUGEINT) % {whole} AS h FROM xx_stripes UNION ALL SELECT x, hex_x, bytes, {(seed + _P5) % _WHOLE}::UHUGEINT + bytes::UHUGEINT FROM xx_text WHERE bytes < 32),
 xx_eights AS (SELECT x, hex_x, bytes, {by_eights} AS h FROM xx_begun),
 xx_fours AS (SELECT x, hex_x, bytes, CASE WHEN bytes % 8 >= 4 THEN {four} ELSE h END AS h FROM xx_eights),
 xx_ones AS (SELECT x, {by_ones} AS h FROM xx_fours),
 xx_once AS (SELECT x, {times(last('h', 33), _P2)} AS h FROM xx_ones), xx_twice AS (SELECT x, {times(last('h', 29), _P3)} AS h FROM xx_once),
 xx_hashed AS (SELECT x, {last('h', 32)} AS h FROM xx_twice)"""


def simhash_sql(shingle: int = 3, most: int = 2) -> str:
    """Fingerprints bit by bit, all pairs of distinct ones, and what each can reach."""
    spaced = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+')"
    bits = " + ".join(f"CASE WHEN 2 * sum(CAST(h // {2**b}::UHUGEINT % 2 AS BIGINT)) > count(*) THEN {2**b}::UHUGEINT ELSE 0::UHUGEINT END" for b in range(64))
    return f"""WITH RECURSIVE word AS (SELECT row_number() OVER () AS nth, doc_id, {spaced} AS w FROM documents),
 shingled AS (SELECT nth, array_to_string(w[i : i + {shingle - 1}], ' ') AS x FROM (SELECT nth, w, unnest(range(1, greatest(len(w) - {shingle - 1}, 1) + 1)) AS i FROM word WHERE len(w) > 0)),
 {xxh64_sql('shingled')},
 marked AS (SELECT nth, CAST({bits} AS UBIGINT) AS fp FROM shingled JOIN xx_hashed USING (x) GROUP BY nth),
 all_marked AS (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM word LEFT JOIN marked USING (nth)),
 node AS (SELECT fp, min(doc_id) AS least FROM all_marked GROUP BY fp),
 edge AS (SELECT a.least AS a, b.least AS b FROM node a JOIN node b ON a.fp <> b.fp AND bit_count(CAST(xor(a.fp, b.fp) AS HUGEINT)) <= {most}),
 reach AS (SELECT least AS root, least AS id FROM node UNION SELECT reach.root, edge.b FROM reach JOIN edge ON edge.a = reach.id WHERE reach.root < edge.b),
 member AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
 SELECT doc_id, printf('%016x', fp) AS fingerprint, component_id FROM all_marked JOIN node USING (fp) JOIN member ON member.id = node.least"""


def merkle_sql(leaf_levels: int = 6, source_levels: int = 4) -> str:
    """Trees level by level, and along them what stands before and after each node in its run.

    The levels are written out: enough for 16^6 documents of a source and 16^4 sources.
    """
    field = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || {x}, '-')"
    steps = "flatten(list_transform(range(1, length(id) + 1), lambda i: [ascii(id[i]), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"

    def tree(name: str, bottom: str, key: str, levels: int) -> str:
        """Levels ``<name>0`` (``bottom``: key, pos, n, node) and up, each with ``before`` and ``after``."""
        out = []
        for k in range(levels + 1):
            rows = bottom if k == 0 else (
                f"SELECT {key}, up AS pos, max((n + 15) // 16) AS n, CASE WHEN max(n) = 1 THEN max(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node "
                f"FROM {name}{k - 1} GROUP BY {key}, up"
            )
            beside = lambda a, b: f"CASE WHEN n > 1 THEN coalesce(string_agg(node, '') OVER (PARTITION BY {key}, up ORDER BY pos ROWS BETWEEN {a} AND {b}), '') ELSE '' END"
            sides = f"{beside('UNBOUNDED PRECEDING', '1 PRECEDING')} AS before, {beside('1 FOLLOWING', 'UNBOUNDED FOLLOWING')} AS after"
            out.append(f"{name}{k} AS (SELECT *, {sides} FROM (SELECT *, pos // 16 AS up FROM ({rows})))")
        return ",\n ".join(out)

    climb, last = [], "(SELECT *, '' AS proof FROM leaf)"
    for k in range(leaf_levels + source_levels):
        name, on = (f"up{k}", f"t.source IS NOT DISTINCT FROM x.source AND t.pos = x.pos // {16 ** k}") if k < leaf_levels else (f"top{k - leaf_levels}", f"t.pos = x.nth // {16 ** (k - leaf_levels)}")
        climb.append(f"climb{k} AS (SELECT x.* REPLACE (proof || t.before || t.after AS proof, CASE WHEN t.n > 1 THEN sha256(t.before || told || t.after) ELSE told END AS told) FROM {last} x JOIN {name} t ON {on})")
        last = f"climb{k}"
    return f"""WITH given AS (SELECT doc_id, source, {field('doc_id')} || {field('source')} || {field('lang')} || {field('n_chars')} AS head, text,
  coalesce(CAST(doc_id AS VARCHAR), '') AS id FROM documents),
 hashed AS (SELECT doc_id, source, sha256(head || {field('text')}) AS leaf, CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295) % 5 = 0
  THEN sha256(head || {field(f"translate(text, '{_UPPER}', '{_LOWER}')")}) ELSE sha256(head || {field('text')}) END AS told FROM given),
 leaf AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
  dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS nth FROM hashed),
 {tree('up', 'SELECT source, pos, n, leaf AS node FROM leaf', 'source', leaf_levels)},
 {tree('top', f'SELECT 0 AS g, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, node FROM up{leaf_levels}', 'g', source_levels)},
 {(","+chr(10)+" ").join(climb)}
 SELECT doc_id, leaf, s.node AS subroot, r.node AS root, sha256(proof) AS proof_sha256, told AS folded_root, told = r.node AS verified
 FROM {last} x JOIN up{leaf_levels} s ON s.source IS NOT DISTINCT FROM x.source CROSS JOIN top{source_levels} r"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_sql(), "op2_simhash_near_dedup": simhash_sql(), "op3_decontaminate": decontamination_sql(), "op4_source_mixing": mixing_sql(),
        "op5_chat_prefix_tree": chat_sql(), "op7_suffix_dedup": repeats_sql(), "op9_media_columns": media_sql(),
        "op12_merkle_manifest": merkle_sql(),
    }
