import pytest

from tallyloom.llm.blocks import CLASSES, BoostedTrees, clean_documents, decode, document_blocks, fit_judge, list_blocks, node_features, weak_labels
from tallyloom.llm.blocks import clean_text as clean_nodes
from tallyloom.llm.markup import LISTED, parse, walk


def listed(body):
    return [(n.kind, n.text) for n, _ in walk(parse(body)) if n.kind in LISTED]


def clean_text(body):
    return clean_nodes([(n, n.kind if n.kind in LISTED else "other") for n, _ in walk(parse(body))])


H, L, C, F = "heading", "list_item", "code_block", "formula"
MD = """---
type: sop
---
# A *b* ![pic](x.png) [link](u "t") [[n|lab]] #

Access
======
- one `x*y`
  goes on
    1. [x] two &amp; 3\\_4
- max_retry_limit **b** <b>c</b>

Costs $5 to $9 here, but $a + b$ there.

$$
x \\in S
$$

```sql title=x
# no heading
- no item $y$
```

<!-- ## old -->
| a | b |
|---|---|
| - x | c |

    indented  code

[ref]: http://x "t"
"""
HTML = """<style>h1{}</style><h2 id=a>In <a title="a > b" href='#x'>put</a>&#38;s<!-- c --></h2>
<ul><li>one<ul><li>in <mark
>ner</mark></li></ul></li><li><p>two \\(x_1\\)</p>
<li>three</ul>
<p>\\[ y \\] $5 to $9</p><pre><code class="k">a &lt; b
# c</code></pre><table><tr><td>no</td></tr></table>"""
WIKI = """== Sco'''pe''' == <!-- x -->
* [[Page|lab]]el [https://a.example b c] if x < y
** deep ''it''
# num
#tight
:<math>a \\cup b</math>
{| class="x"
| * no
|}
<syntaxhighlight lang="py">
== no ==
* no {{t}}
</syntaxhighlight>
"""
TEX = r"""\documentclass{article}
\begin{document}
\section[short]{Lim\textbf{its} at 40\% load}\label{s}
\begin{itemize}[x=1]
  \item Q\&A {\itshape it} \verb|a_b|
  % \item gone
  \item[--] out \href{http://x}{here}
  \begin{enumerate}
    \item deep $n^2$
  \end{enumerate}
\end{itemize}
Costs \$5 to \$9.
\begin{equation}\label{e}
x = 1
\end{equation}
\begin{verbatim}
\section{no} % $y$
\end{verbatim}
\begin{tabular}{ll} a & b \\ \end{tabular}
\end{document}
"""


@pytest.mark.parametrize(
    "body, want",
    [
        (MD, [(H, "A b pic link lab"), (H, "Access"), (L, "one x*y goes on"), (L, "two & 3_4"), (L, "max_retry_limit b c"), (F, "a + b"), (F, "x \\in S"), (C, "# no heading - no item $y$"), (C, "indented code")]),
        (HTML, [(H, "In put&s"), (L, "one"), (L, "in ner"), (L, "two x_1"), (F, "x_1"), (L, "three"), (F, "y"), (C, "a < b # c")]),
        (WIKI, [(H, "Scope"), (L, "label b c if x < y"), (L, "deep it"), (L, "num"), (L, "tight"), (F, "a \\cup b"), (C, "== no == * no {{t}}")]),
        (TEX, [(H, "Limits at 40% load"), (L, "Q&A it a_b"), (L, "out here"), (L, "deep n^2"), (F, "n^2"), (F, "x = 1"), (C, "\\section{no} % $y$")]),
        (None, []), (" \n ", []), ("plain words", []),
    ],
)
def test_each_markup(body, want):
    assert sorted(listed(body)) == sorted(want)
    assert sorted(listed(body and body.replace("\n", "\r\n"))) == sorted(want)


def test_deep_and_long_documents_end():
    assert len(listed("\n".join("  " * k + "- x" for k in range(300)))) == 300
    assert len(listed("<ul><li>a" * 1500)) == 1500
    assert len(listed("- item\n" * 20000)) == 20000
    assert listed("```\n" + "x " * 50000)[0][0] == C


def test_decoding_contradicts_nothing():
    import numpy as np

    nodes, parents, rows = node_features(parse("- a\n\n```\nb\n```\n\n# c $d$"))
    logs = np.full((len(nodes), len(CLASSES)), -9.0)
    logs[:, CLASSES.index("code_block")] = 0.0
    classes = decode(nodes, parents, logs)
    for at, p in enumerate(parents):
        if p >= 0 and CLASSES[classes[p]] in ("code_block", "formula"):
            assert classes[at] == 0


def test_trees_learn_the_classes():
    import numpy as np

    roots = [parse(b) for b in (MD, HTML, WIKI, TEX)] * 4
    x = np.concatenate([node_features(r)[2] for r in roots])
    y = np.array([k for r in roots for k in weak_labels(r, None)])
    model = BoostedTrees(len(CLASSES)).fit(x, y)
    assert (model.log_odds(x).argmax(axis=1) == y).mean() > 0.99


def test_blocks_in_spark(spark):
    rows = [(k, b, "clash") for k, b in enumerate([MD, HTML, WIKI, TEX] * 5)] + [(0, MD, "clash"), (50, None, None), (51, "", None), (None, MD, None)]
    bodies = spark.createDataFrame(rows, "body_id bigint, body string, block_kind string")
    sections = spark.createDataFrame([(k, 0, t) for k in range(20) for t in ("A b pic link lab", "Access", "In put&s", "Scope", "Limits at 40% load")], "body_id bigint, ord int, title string")
    got = [tuple(r) for r in document_blocks(bodies, sections).collect()]
    want = {(k, *b) for k, body, _ in rows[:20] for b in listed(body)}
    assert len(got) == len(set(got)) and len(want - set(got)) <= 0.02 * len(want) and set(got) <= want
    assert document_blocks(bodies.limit(0), sections).collect() == []
    clean = {r["body_id"]: r["clean"] for r in clean_documents(bodies, sections).collect()}
    assert clean[50] is None and clean[51] == "" and clean[0] == clean_text(MD) and len(clean) == 22
    assert {r["body_id"]: r["clean"] for r in clean_documents(bodies.where("body_id > 49"), sections).collect()} == {50: None, 51: ""}


def test_clean_text_keeps_structure():
    said = clean_text(MD)
    assert said.startswith("# A b pic link lab") and "- two & 3_4" in said and "```\n# no heading" in said and "$$ x \\in S $$" in said and "old" not in said
    assert clean_text(None) == "" and clean_text("") == ""


def test_clean_text_keeps_the_words_of_tables():
    assert clean_text("# T\n\n| a **b** | c \\| d |\n|---|:-:|\n| `e` | $x$ |\n\nend") == "# T\n\na b | c | d\ne | x\n\nend"
    assert clean_text("<table><caption>cap</caption><tr><th>a</th><td>b <b>c</b></td></tr><tr><td>d<p>e</p></td></tr></table><p>end</p>") == "cap\na | b c\nd\n\ne\n\nend"
    wiki = clean_text("== T ==\n{| class=\"x\"\n|+ cap\n! h1 !! h2\n|-\n| style=\"y\" | a || [[l|b]]\n|-\n| c\nmore\n|}\nend\n")
    assert wiki == "# T\n\ncap\nh1 | h2\na | b\nc more\n\nend"
    tex = clean_text("\\section{T}\n\\begin{tabular}{l|c}\n\\hline a & \\textbf{b} \\\\\n\\multicolumn{2}{c}{d \\& e} \\\\ \\cline{1-2}\n$x$ & 5\\% \\\\\n\\end{tabular}\nend")
    assert tex == "# T\n\na | b\nd & e\nx | 5%\n\nend"


@pytest.mark.parametrize(
    "body, want",
    [
        ("# A\n- b\n\n== Wiki ==\n\n* c", [(H, "A"), (L, "b"), (H, "Wiki"), (L, "c")]),
        ("== W ==\n\n'''x'''\n\n* a\n\n\\section{Tex \\emph{t}}\n\n\\begin{itemize}\n\\item one\n\\end{itemize}", [(H, "W"), (L, "a"), (H, "Tex t"), (L, "one")]),
        ("\\section{One}\n\\textbf{x} \\emph{y}\n\n## Md head\n\n```\n\\section{no}\n```\n\n\\section{Two}", [(H, "One"), (H, "Md head"), (C, "\\section{no}"), (H, "Two")]),
        ("# Md\n\n- a\n\n\\begin{verbatim}\n== no ==\n\\end{verbatim}\n\n```\n== no ==\n\\section{no}\n```\n\n**b**\n", [(H, "Md"), (L, "a"), (C, "== no =="), (C, "== no == \\section{no}")]),
        ("a\n\n***\n\n- x\n\n* * *\n\n_ _ _\n\n- y", [(L, "x"), (L, "y")]),
        ("# sign \ue000 and \ue001 \ue002\n\n- `\ue0001\ue001`", [(H, "sign \ue000 and \ue001 \ue002"), (L, "\ue0001\ue001")]),
    ],
)
def test_mixed_markup_block_by_block(body, want):
    assert sorted(listed(body)) == sorted(want)


def test_trees_have_the_word_where_syntax_is_not_borne_out():
    bodies = [f"# Real {k}\n\nsome words here\n\nMaybe {k}\n=======\n\n- an item\n" for k in range(30)]
    judge = fit_judge(bodies, [{f"Real {k}"} for k in range(30)])
    assert set(list_blocks([bodies[3]], judge)[0]) == {(H, "Real 3"), (L, "an item")}
    assert set(list_blocks([bodies[3]], fit_judge(bodies, [None] * 30))[0]) == {(H, "Real 3"), (H, "Maybe 3"), (L, "an item")}
