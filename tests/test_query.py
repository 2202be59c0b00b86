"""The translator against sqlite3: every expression and query gives the same rows with the same storage classes."""

import sqlite3

import pytest

from logfold import dialect
from logfold.model import InvalidChangeError
from logfold.query import kind_of

ROWS = [(1, "a", 7, 1.5, "12", b"\x01"), (2, "a", 3, -2.25, "abc", None), (3, "b", None, None, "3x", b"zz"), (4, "b", -8, 0.0, None, b""), (5, "c", 7, 10.0, "7", b"\xff\x00"), (6, "A", 0, 4.5, "it's", b"q")]
RANGES = [(1, 0, 3, "low"), (2, 3, 8, "mid"), (9, 8, 99, "high")]

EXPRESSIONS = [
    '7/2',
    '-7/2',
    '1/0',
    '1.0/0',
    '7%0',
    '7.5%2',
    "'abc'+1",
    "'3x'+1",
    "'3.5'+1",
    "CAST('12abc' AS INTEGER)",
    "CAST('abc' AS REAL)",
    'CAST(3.9 AS INTEGER)',
    'CAST(12 AS TEXT)',
    "CAST('x' AS BLOB)",
    "1='1'",
    "1<'1'",
    '1=1.0',
    "'a'<x'61'",
    '9223372036854775807+1',
    '9223372036854775807',
    '-9223372036854775808',
    '1=1',
    'NOT 1',
    'NOT 0',
    '1 AND 0',
    'NULL OR 1',
    '2 OR 0',
    "'ABC' LIKE 'abc'",
    "'a\\b' LIKE 'a\\_'",
    "'a_b' LIKE 'a!_b' ESCAPE '!'",
    "'abc' GLOB 'a*'",
    "'Abc' GLOB 'a*'",
    "'a]c' GLOB 'a[]]c'",
    "glob('a?','ab')",
    "like('A%','abc')",
    'round(2.5)',
    'round(2.567,2)',
    'typeof(1)',
    'typeof(1.5)',
    "typeof('x')",
    'typeof(NULL)',
    "typeof(x'00')",
    'typeof(1/2)',
    'typeof(1+1.0)',
    "length('abc')",
    "length(x'0102')",
    'length(12345)',
    "upper('aé')",
    "lower('AÉ')",
    "trim('  a ')",
    "ltrim('xxa','x')",
    "replace('aXbX','X','--')",
    "instr('hello','l')",
    "hex('abc')",
    "hex(x'ff00')",
    "quote('it''s')",
    'quote(5)',
    "quote(x'ff')",
    'quote(NULL)',
    "unicode('é')",
    'char(72,233,128512)',
    "soundex('Robert')",
    "soundex('')",
    "printf('%d-%s-%05.2f','7','x',3.14159)",
    'abs(-5)',
    'sign(-3)',
    'max(1,2,3)',
    'min(1,NULL)',
    'coalesce(NULL,2,3)',
    "ifnull(NULL,'x')",
    'nullif(1,1)',
    'nullif(1,2)',
    "iif(0,'a','b')",
    'zeroblob(2)',
    '1 IS 1',
    '1 IS NOT NULL',
    'NULL IS NULL',
    'NULL IS 1',
    '1 IS NOT DISTINCT FROM 1',
    '1 IN (1,2)',
    "1 IN ('1',2)",
    '3 NOT IN (1,2)',
    'NULL IN (1)',
    '5 BETWEEN 1 AND 9',
    "CASE 3 WHEN 3 THEN 'x' ELSE 'y' END",
    'CASE WHEN 0 THEN 1 END',
    '5 & 3',
    '5 | 8',
    '~5',
    '1 << 4',
    '256 >> 2',
    "'a' || 1 || 2.5",
    "'a' || NULL",
    '-(-3)',
    "+'a'",
    '(1,2)=(1,2)',
    '(1,2)<(1,3)',
    "date('2024-02-29','+1 year')",
    "date('2024-01-31','+1 month')",
    "datetime('2024-01-31 10:11:12','-1 day','start of month')",
    "time('10:11:12')",
    "datetime(0,'unixepoch')",
    'date(2460000.5)',
    "julianday('2000-01-01 12:00:00')",
    "strftime('%Y/%m/%d %H-%M-%S %j %w %s %%','2024-03-05 06:07:08')",
    "strftime('%W','2024-03-05')",
    "date('2024-03-05','weekday 0')",
    "date('2024-03-05','+12 hours','+1.5 days')",
    "date('nonsense')",
    'json(\'{"a": [1, 2]}\')',
    'json_extract(\'{"a":{"b":"x"}}\',\'$.a.b\')',
    '\'{"a":{"b":"x"}}\' -> \'$.a\'',
    '\'{"a":{"b":"x"}}\' -> \'a\'',
    '\'{"a":"x"}\' ->> \'a\'',
    'json_valid(\'{"a"\')',
    "json_valid('{}')",
    'json_type(\'{"a":1}\',\'$.a\')',
    "json_type('[1]')",
    'json_type(\'{"a":"s"}\',\'$.a\')',
    "json_array_length('[1,2,3]')",
    "json_array(1,'a',NULL,2.5)",
    "json_object('a',1,'b','x')",
    'json_quote(\'a"b\')',
    "substr('hello',2)",
    "substr('hello',-3,2)",
    "substr('hello',0,3)",
    "substr(x'010203',2,1)",
    'CAST(NULL AS INTEGER)',
    "x'ff00'",
    'pow(2,10)',
    'sqrt(16)',
    'ceil(1.2)',
    'floor(-1.5)',
    'trunc(-1.7)',
    'log(100)',
    'log(2,8)',
    'mod(7,3)',
    "'10' < 9",
    "'10' + '5'",
    "'5' * 2",
    "unixepoch('2024-01-01')",
]

QUERIES = [
    'SELECT * FROM t ORDER BY id',
    'SELECT id, n/2, n%3, n*1.0/2 FROM t ORDER BY id',
    "SELECT id, n > 2, n = '7', s = 7, s < 10 FROM t ORDER BY id",
    'SELECT id FROM t WHERE n ORDER BY id',
    'SELECT id FROM t WHERE s ORDER BY id',
    'SELECT id, typeof(n), typeof(s), typeof(r), typeof(b) FROM t ORDER BY id',
    'SELECT id, CAST(s AS INTEGER) FROM t ORDER BY id',
    'SELECT g, max(n), id, r FROM t GROUP BY g ORDER BY g',
    'SELECT max(id), g, s FROM t',
    'SELECT min(r), id FROM t',
    'SELECT g, count(*), sum(n), avg(n), total(n), min(s) FROM t GROUP BY g ORDER BY 1',
    'SELECT g AS k, count(*) AS c FROM t GROUP BY k HAVING c > 1 ORDER BY c DESC, k',
    'SELECT n+1 AS m, count(*) FROM t GROUP BY n+1 ORDER BY m',
    'SELECT count(DISTINCT n), sum(DISTINCT n) FROM t',
    'SELECT count(*) FILTER (WHERE n > 2) FROM t',
    'SELECT group_concat(s) FROM (SELECT s FROM t ORDER BY id)',
    "SELECT group_concat(s, '|') FROM (SELECT s, id FROM t ORDER BY id DESC)",
    'SELECT json_group_array(n) FROM (SELECT n FROM t ORDER BY id)',
    'SELECT id, row_number() OVER (ORDER BY id DESC) AS k, sum(n) OVER (PARTITION BY g ORDER BY id) FROM t ORDER BY id',
    'SELECT id, lag(id) OVER (ORDER BY id), lead(id, 2, -1) OVER w, first_value(s) OVER w, nth_value(id, 2) OVER w FROM t WINDOW w AS (ORDER BY id) ORDER BY id',
    'SELECT id, sum(n) OVER (ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), ntile(2) OVER (ORDER BY id), percent_rank() OVER (ORDER BY id) FROM t ORDER BY id',
    'SELECT id, last_value(id) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) FROM t ORDER BY id',
    'SELECT t.id, u.name FROM t JOIN u ON t.n >= u.lo AND t.n < u.hi ORDER BY t.id',
    'SELECT t.id, name FROM t LEFT JOIN u USING (id) ORDER BY 1',
    'SELECT id, name FROM t NATURAL JOIN u ORDER BY 1',
    'SELECT count(*) FROM t, u',
    'SELECT count(*) FROM t CROSS JOIN u',
    'SELECT a.id, b.id FROM t a JOIN t AS b ON a.n = b.n AND a.id < b.id',
    'SELECT id FROM t WHERE id IN (SELECT id FROM u) ORDER BY 1',
    'SELECT id FROM t WHERE id NOT IN (SELECT id FROM u) ORDER BY 1',
    'SELECT id FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.id = t.id) ORDER BY 1',
    'SELECT id FROM t WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.id = t.id) ORDER BY 1',
    'SELECT id, (SELECT max(name) FROM u WHERE u.lo <= t.n) FROM t ORDER BY id',
    'SELECT id FROM t ORDER BY n, id LIMIT 2 OFFSET 1',
    'SELECT id FROM t ORDER BY n DESC, id LIMIT 1, 2',
    'SELECT id FROM t ORDER BY s DESC NULLS FIRST, id',
    'SELECT id FROM t ORDER BY id LIMIT -1',
    'SELECT DISTINCT g FROM t ORDER BY g',
    'SELECT g FROM t UNION SELECT name FROM u ORDER BY 1',
    'SELECT id FROM t EXCEPT SELECT id FROM u ORDER BY 1',
    'SELECT id FROM t UNION ALL SELECT id FROM u INTERSECT SELECT 9',
    'WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x+1 FROM c WHERE x < 5) SELECT sum(x), count(*) FROM c',
    'WITH q AS (SELECT id, n/2 AS h FROM t) SELECT h FROM q WHERE h > 0 ORDER BY 1',
    "VALUES (1,'a'),(2,'b')",
    'SELECT column1+1 FROM (VALUES (1),(2)) ORDER BY 1',
    "SELECT g = 'a' COLLATE NOCASE FROM t ORDER BY id",
    'SELECT count(*) FROM t GROUP BY g COLLATE NOCASE ORDER BY 1',
    'SELECT id FROM t WHERE n IS NULL OR r IS NOT 1.5 ORDER BY 1',
    'SELECT id, length(b), hex(b) FROM t ORDER BY id',
    'SELECT sum(n) FROM t WHERE 0',
    'SELECT count(*), id FROM t WHERE 0',
    'SELECT x.id FROM (SELECT id, n FROM t WHERE n > 0) x JOIN u ON x.id = u.id ORDER BY x.n',
    'SELECT id, n FROM t WHERE (id, n) IN (SELECT id, 7 FROM t) ORDER BY id',
    'SELECT max(n) - min(n) AS d FROM t',
    'SELECT "id", [g], `n` FROM t WHERE "g" = \'a\' ORDER BY id',
    'SELECT sum(n) AS s2 FROM t GROUP BY g ORDER BY s2',
    'SELECT g FROM t GROUP BY g ORDER BY max(n) DESC, g',
]


@pytest.fixture(scope="module")
def both(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, g TEXT, n INTEGER, r REAL, s TEXT, b BLOB)")
    db.execute("CREATE TABLE u(id INTEGER PRIMARY KEY, lo INTEGER, hi INTEGER, name TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)", ROWS)
    db.executemany("INSERT INTO u VALUES (?, ?, ?, ?)", RANGES)
    spark.createDataFrame(ROWS, "id long, g string, n long, r double, s string, b binary").coalesce(1).createOrReplaceTempView("t")
    spark.createDataFrame(RANGES, "id long, lo long, hi long, name string").coalesce(1).createOrReplaceTempView("u")
    kinds = {n: {f.name: kind_of(f.dataType.simpleString()) for f in spark.table(n).schema} for n in ("t", "u")}

    def run(sql):
        found = [tuple(map(plain, r)) for r in spark.sql(dialect.translate(sql, lambda n: kinds.get(n.lower()))).collect()]
        return found, [tuple(map(plain, r)) for r in db.execute(sql).fetchall()]

    yield run
    spark.catalog.dropTempView("t")
    spark.catalog.dropTempView("u")


def plain(v):
    """With its class, so that 1, 1.0 and True differ."""
    if isinstance(v, bytearray):
        v = bytes(v)
    return type(v).__name__, round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("at", range(0, len(EXPRESSIONS), 12))
def test_expressions(both, at):
    got, want = both("SELECT " + ", ".join(EXPRESSIONS[at : at + 12]))
    assert list(zip(EXPRESSIONS[at:], got[0])) == list(zip(EXPRESSIONS[at:], want[0]))


@pytest.mark.parametrize("sql", QUERIES)
def test_queries(both, sql):
    got, want = both(sql)
    assert got == want if "ORDER BY" in sql else sorted(got, key=str) == sorted(want, key=str)


def test_numbers_of_texts_and_json(both):
    for sql in ("SELECT id, s + 1 FROM t ORDER BY id", "SELECT abs('-5')"):  # equal numbers, of another class
        got, want = both(sql)
        assert [[v for _, v in r] for r in got] == [[v for _, v in r] for r in want]
    assert [[v for _, v in r] for r in both("""SELECT key, value, type FROM json_each('[5,"x"]')""")[0]] == [["0", "5", "integer"], ["1", "x", "text"]]


def test_bound_values_and_errors(spark):
    sql = dialect.translate("SELECT ? + 1 AS a, ? AS b, ?2 AS c, ? AS d", args=[1, "it's \\ ?", None])
    assert tuple(spark.sql(sql).first()) == (2, "it's \\ ?", "it's \\ ?", None)
    for bad in ("SELECT", "SELECT 1 +", "SELECT nothing(1)", "SELECT ?", "SELECT 1 FROM", "SELECT sum(x) OVER (ORDER BY x GROUPS 1 PRECEDING) FROM t", "SELECT 1 2 3"):
        with pytest.raises(InvalidChangeError):
            dialect.translate(bad)
