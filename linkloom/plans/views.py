"""Derived tables that give the test data the signals the operators look for.

Plain documents and pages hold no URL, amount or wall.  These views add them
to the whole text of every row.  Each view is one SQL text that Spark and
DuckDB both read, so both sides of a check start from the same rows.
"""

HOT_URL = "https://hot.example.org/handbook"  # cited by a third of all documents

_PATH = """concat(CASE {id} % 6 WHEN 0 THEN 'docs/adr/' WHEN 1 THEN 'research/' WHEN 2 THEN 'src/api/'
         WHEN 3 THEN 'tests/' WHEN 4 THEN 'src/README-' ELSE 'zz/' END, cast({id} AS string), '.md')"""


def _items(pattern: str, n: int) -> str:
    """A text literal with the pattern for 0 to n - 1 in a row."""
    return "'" + "".join(pattern.format(i) for i in range(n)) + "'"


# More of everything than the established limits report, and longer than they let through.
_LONG = "which goes on and on until nobody would read it to its end, "
_MANY_FACTS = _items("<p>worth ${0}.5 million, up {0}%</p>", 14)
_MANY_BLOCKS = f"""concat({_items(f'<h2>Topic {{0}} {_LONG * 4}</h2><p>Body {{0}} of the topic.</p>', 60)}, '<p>{_LONG * 40}</p>',
    {_items(f'<a href="/all/{{0}}">Entry {{0}} {_LONG * 2}é</a>', 60)}, {_items('<a href="/all/{0}">Entry {0} again</a>', 5)},
    {_items('<pre><code class="lang-sh">run step {0} of all</code> and look</pre>', 25)},
    '<pre class="x language-py">', repeat('print(1) ', 700), '</pre>', {_items('<pre>block {0} of all</pre>', 4)})"""
_BOOK = f"""concat({_items(f'{{0}}.1. CHAPTER OF THE BOOK{chr(10)}{chr(10)}This is what chapter {{0}} says about it, https://x.example.org/{{0}}/{"a" * 90}, at last.{chr(10)}', 130)},
    {_items(f'plain words{chr(10)}def f{{0}}(x):{chr(10)}    y = x{chr(10)}    return y{chr(10)}{chr(10)}', 14)}, 'the end', chr(10),
    repeat(concat('    z = 1  # import', chr(10)), 400))"""

VIEWS = {
    # markdown files: every document cites one page by a link and another one bare
    "corpus": f"""
SELECT d.doc_id, {_PATH.format(id='d.doc_id')} AS path,
  concat(d.text, chr(10),
    '- [Page ', cast(p.page_id AS string), '](', p.url, ') and bare ', q.url, '. Again: ', q.url, ',', chr(10),
    p.url, chr(10),
    CASE WHEN d.doc_id % 3 <> 0 THEN '' WHEN d.doc_id % 2 = 0 THEN '[Handbook]({HOT_URL}), ' ELSE 'See {HOT_URL}; ' END,
    CASE WHEN d.doc_id % 9 = 0 THEN concat('[', p.url, '](', p.url, ')') ELSE '' END,
    CASE WHEN d.doc_id % 23 = 0 THEN '[quoted](https://q.example.org/a]b)' ELSE '' END, chr(10),
    'Follow https://instagram.com/user', cast(d.doc_id % 40 AS string), ') and https://www.statista.com/s/',
    cast(d.doc_id % 50 AS string), ', https://techcrunch.com/', cast(d.doc_id AS string), '. ', chr(10),
    'cap $', cast(d.doc_id AS string), '.5 million, fee $', cast(d.n_chars AS string), ' and up ',
    cast(d.n_chars % 100 AS string), ' %, now ', cast(d.doc_id % 7 AS string), '%',
    CASE WHEN d.doc_id % 41 = 0 THEN {_MANY_FACTS} ELSE '' END) AS content
FROM (SELECT doc_id, text, n_chars, doc_id % (SELECT count(*) FROM pages) AS p_id,
        (doc_id * 7 + 3) % (SELECT count(*) FROM pages) AS q_id FROM documents) d
JOIN pages p ON d.p_id = p.page_id JOIN pages q ON d.q_id = q.page_id""",
    # a later scan: edited files (same paths) and new ones
    "notes": f"""
SELECT CASE WHEN c.turn = 0 THEN {_PATH.format(id='c.conv_id')}
    ELSE concat('research/notes/', cast(c.conv_id AS string), '-', cast(c.turn AS string), '.md') END AS path,
  concat(c.text, chr(10), '[Topic ', cast(p.page_id AS string), '](', p.url, ') and {HOT_URL} or https://new.example.org/',
    cast(c.conv_id AS string), '.') AS content
FROM (SELECT conv_id, turn, text, conv_id * 7 % (SELECT count(*) FROM pages) AS p_id FROM conversations) c
JOIN pages p ON c.p_id = p.page_id""",
    # fetch attempts: a failed first attempt is followed by a second one; some URLs' numbers start late
    "crawl": f"""
WITH attempts AS (
  SELECT page_id, url,
    CASE WHEN page_id % 7 = 0 THEN concat('https://moved.example.net/', cast(page_id AS string))
         WHEN page_id % 5 = 0 THEN replace(url, '://', '://www.') ELSE url END AS final_url,
    CASE WHEN page_id % 11 = 0 THEN '404 Not Found' WHEN page_id % 17 = 0 THEN 'Access Denied'
         WHEN page_id % 19 = 0 THEN 'Fortune 500 list' ELSE 'Fine page' END AS title,
    CASE WHEN page_id % 6 = 0 THEN concat(html, '<div>Subscribe to Continue</div>')
         WHEN page_id % 8 = 0 THEN concat(html, '<p class="auth-wall">x</p>')
         WHEN page_id % 9 = 0 THEN concat(html, '<p>Please sign in</p>') ELSE html END AS html,
    CASE WHEN page_id % 13 = 0 THEN 'net::ERR_NAME_NOT_RESOLVED'
         WHEN page_id % 29 = 0 THEN 'net::ERR_CERT_DATE_INVALID' END AS error
  FROM (SELECT page_id, html, CASE WHEN page_id = 1 THEN '{HOT_URL}' ELSE url END AS url FROM pages) p)
SELECT url, final_url, title, html, error, CASE WHEN page_id % 31 = 0 THEN 3 ELSE 1 END AS attempt FROM attempts
UNION ALL
SELECT url, final_url, title, html, CASE WHEN page_id % 13 <> 0 THEN error END AS error,
  CASE WHEN page_id % 31 = 0 THEN 5 ELSE 2 END AS attempt
FROM attempts WHERE error IS NOT NULL""",
    "facts": f"""
SELECT concat(CASE page_id % 4 WHEN 0 THEN 'https://instagram.com/user' WHEN 1 THEN 'https://www.statista.com/s/'
             WHEN 2 THEN 'https://techcrunch.com/' ELSE 'https://plain.example.org/' END,
        cast(page_id AS string), CASE WHEN page_id % 3 = 0 THEN '/' ELSE '' END) AS url,
  concat(CASE WHEN page_id % 5 = 0 THEN replace(html, '<h1>', '<h2>') ELSE html END,
    '<p>', cast(page_id AS string), 'K Followers. Worth $', cast(page_id AS string), ' billion or $5 Bananas, up ',
    cast(page_id AS string), ' % from 3%</p>', CASE WHEN page_id % 25 = 2 THEN {_MANY_FACTS} ELSE '' END) AS html
FROM pages""",
    "papers": f"""
SELECT doc_id, concat('papers/', cast(doc_id AS string), '.v1.pdf') AS path,
  CASE WHEN doc_id % 50 = 49 THEN '' WHEN doc_id % 50 = 48 THEN cast(NULL AS string) ELSE
  concat('REPORT ', cast(doc_id AS string), chr(10), 'Author: ', source, chr(10),
    'Published: 2024-01-', CASE WHEN doc_id % 28 < 9 THEN '0' ELSE '' END, cast(doc_id % 28 + 1 AS string), chr(10),
    'DOI: 10.1234/x.', cast(doc_id AS string), chr(10), chr(10), text, chr(10),
    '1.2. METHODS AND DATA', chr(10), '    def f(x):', chr(10), '    return x', chr(10), '    # done here', chr(10),
    text, ' see https://doi.example.org/', cast(doc_id AS string), '.', chr(10),
    CASE WHEN doc_id % 200 = 7 THEN {_BOOK} ELSE '' END,
    'Chapter 2 results', chr(10), chr(10), text) END AS text
FROM documents""",
    "rich_pages": f"""
SELECT page_id, url,
  replace(replace(html, '<meta charset="utf-8">',
    concat('<meta charset="utf-8"><meta property="og:site_name" content="Site ', cast(page_id % 5 AS string), '">',
      CASE WHEN page_id % 2 = 0 THEN '<meta name="author" content="A. Writer">' ELSE '<meta property="article:author" content="B. Writer">' END,
      CASE WHEN page_id % 3 = 0 THEN '<meta name="citation_doi" content="10.1234/p">' ELSE '' END,
      '<meta name="date" content="2024-01-05">')),
    '</article>',
    concat(CASE WHEN page_id % 25 = 3 THEN {_MANY_BLOCKS} ELSE '' END, '<h2>Part ', cast(page_id AS string), '</h2><h3>Detail</h3><p>Tail text of the page.</p>',
      '<a href="/next/', cast(page_id + 1 AS string), '">Next page</a><a href="#top">Top</a><a href="/n">Go</a>',
      '<a href="https://doi.org/10.1234/l">Paper</a><a href="/next/', cast(page_id + 1 AS string), '">Again</a>',
      '<pre><code class="language-rust">fn main() -> i32 {{ 42 }}</code></pre><pre class="lang-py">print("hello world")</pre></article>')) AS html
FROM pages""",
    # pages without paragraphs: their text is all there is
    "bare_pages": "SELECT url, replace(replace(html, '<p>', '<br>'), '</p>', '<br>') AS html FROM pages",
}
