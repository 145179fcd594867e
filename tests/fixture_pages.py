"""Front matter in the ways that people write it."""

FRONT = [
    "title: Plain title\nlang: en",
    'title: "Doc 1: a \\"quoted\\" part"\nother: \'it\'\'s\'',
    "tags: [a, b c, \"d, e\", 'f, g']\nempty: []\nnone:\nnull_too: ~",
    "source_files:\n- raw/a.md\n- \"raw/b: c.md\"\n- 'raw/d.md'\nlast_updated: 2026-01-02",
    "source_files:\n  - raw/a.md\n  - raw/b.md\nn: 3\nx: 1.5\nb: true",
    "tags: first\ntags: [last, wins]\ntitle: t",
    "summary: |\n  line one\n  line two\n\n  line four\ntitle: after",
    "summary: >\n  folded one\n  folded two\n\n  new paragraph\ntitle: after",
    "summary: |-\n  no end\nkey: v",
    "long: this goes\n  on here\n  and here\nnext: n",
    "# a comment\ntitle: t # trailing\nurl: http://a.b/c#d\n\"quoted key\": v",
    "제목: 한글 키\ntags: [\"가\", '나']",
    "tags: [a,\n  b,\n  c]\nend: 1",
    "neg: -5\nplus: +7\nyes_: yes\nno_: 'no'\ndate_text: '2026-01-02'",
    "esc: \"tab\\there\\nnew \\u00e9\"\nback: 'a\\b'",
    "items:\n- one\n-\n- three",
    "",
]
