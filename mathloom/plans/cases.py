"""Cases that the tables hardly hold, each an input with what must come of it, for queries and their SQL alike.

The expected values were written down from a run and read through against the rules of the grammar, of detection and of
MathML; they guard against change.  The tables' own formulas are held against SQL that shares nothing with the operators (``oracle_parse``).  Findings are
level, type, place, index and message; trees in pre-order number < parent, role, place among its
kind, type, value and * for a nested script; tokens type, place and value.
"""

from __future__ import annotations


#: LaTeX, findings, tree, tokens.
PARSES = (
    ('a_6^2', '', '0< root0 root; 1<0 child0 superscript *; 2<1 base0 subscript; 3<2 base0 variable a; 4<2 child0 number 6; 5<1 child0 number 2', 'variable:0:a subscript:1:_ number:2:6 superscript:3:^ number:4:2'),
    ('{u}^{v}_{w}', '', '0< root0 root; 1<0 child0 subscript *; 2<1 base0 superscript; 3<2 base0 group; 4<3 child0 variable u; 5<2 child0 variable v; 6<1 child0 variable w', 'group:0:{ variable:1:u group:2:} superscript:3:^ group:4:{ variable:5:v group:6:} subscript:7:_ group:8:{ variable:9:w group:10:}'),
    ('\\frac{p}{q6} } {', 'E unmatched_brace 13 9 Unmatched closing brace; E unmatched_brace 15 11 Unmatched opening brace', '0< root0 root; 1<0 child0 command \\frac; 2<0 child1 group; 3<2 child0 variable p; 4<0 child2 group; 5<4 child0 variable q; 6<4 child1 number 6; 7<0 child3 group }; 8<0 child4 group', 'command:0:\\frac group:5:{ variable:6:p group:7:} group:8:{ variable:9:q number:10:6 group:11:} spacing:12: group:13:} spacing:14: group:15:{'),
    ('\\left( x \\right', 'W unmatched_delimiter 5 1 Possibly unmatched delimiter: (', '0< root0 root; 1<0 child0 delimiter_pair \\left; 2<1 delimiter0 delimiter (; 3<0 child1 variable x; 4<0 child2 command \\right', 'command:0:\\left delimiter:5:( spacing:6: variable:7:x spacing:8: command:9:\\right'),
    ('\\left\\{ y', 'E unmatched_delimiter 0 0 Unmatched \\left; W unknown_command 5 1 Unknown command: \\{', '0< root0 root; 1<0 child0 delimiter_pair \\left; 2<1 delimiter0 command \\{; 3<0 child1 variable y', 'command:0:\\left command:5:\\{ spacing:7: variable:8:y'),
    ('\\right] t', 'E unmatched_delimiter 0 0 Unmatched \\right', '0< root0 root; 1<0 child0 delimiter_pair \\right; 2<1 delimiter0 delimiter ]; 3<0 child1 variable t', 'command:0:\\right delimiter:6:] spacing:7: variable:8:t'),
    ('\\begin{cases} m \\end{matrix}', 'E mismatched_environment 16 4 Mismatched environment: \\end{matrix}; E unclosed_environment 0 0 Unclosed environment: cases', '0< root0 root; 1<0 child0 environment cases; 2<1 child0 variable m; 3<1 child1 environment \\end{matrix}', 'environment:0:\\begin{cases} spacing:13: variable:14:m spacing:15: environment:16:\\end{matrix}'),
    ('\\begin{pmatrix} 4 & 6 \\end{pmatrix}^T', '', '0< root0 root; 1<0 child0 superscript; 2<1 base0 environment pmatrix; 3<2 child0 number 4; 4<2 child1 symbol &; 5<2 child2 number 6; 6<1 child0 variable T', 'environment:0:\\begin{pmatrix} spacing:15: number:16:4 spacing:17: symbol:18:& spacing:19: number:20:6 spacing:21: environment:22:\\end{pmatrix} superscript:35:^ variable:36:T'),
    ('\\sqrt[3]{h}', '', '0< root0 root; 1<0 child0 command \\sqrt; 2<0 child1 optional [3]; 3<0 child2 group; 4<3 child0 variable h', 'command:0:\\sqrt optional:5:[3] group:8:{ variable:9:h group:10:}'),
    ('\\plot[color=red, width=]{g}', 'W empty_option_value 5 1 Empty value for option: width; W unknown_command 0 0 Unknown command: \\plot', '0< root0 root; 1<0 child0 command \\plot; 2<0 child1 optional [color=red, width=]; 3<0 child2 group; 4<3 child0 variable g', 'command:0:\\plot optional:5:[color=red, width=] group:24:{ variable:25:g group:26:}'),
    ('k \\\\[2pt] l', 'W unknown_command 2 0 Unknown command: \\', '0< root0 root; 1<0 child0 variable k; 2<0 child1 command \\\\; 3<0 child2 optional [2pt]; 4<0 child3 variable l', 'variable:0:k spacing:1: command:2:\\\\ optional:4:[2pt] spacing:9: variable:10:l'),
    ('\\newcommand{\\half}{0.5} \\half n', '', '0< root0 root; 1<0 child0 command \\newcommand; 2<0 child1 group; 3<2 child0 macro \\half; 4<0 child2 group; 5<4 child0 number 0.5; 6<0 child3 macro \\half; 7<0 child4 variable n', 'command:0:\\newcommand group:11:{ macro:12:\\half group:17:} group:18:{ number:19:0.5 group:22:} spacing:23: macro:24:\\half spacing:29: variable:30:n'),
    ('\\def\\zed{Z} \\zed', '', '0< root0 root; 1<0 child0 command \\def; 2<0 child1 macro \\zed; 3<0 child2 group; 4<3 child0 variable Z; 5<0 child3 macro \\zed', 'command:0:\\def macro:4:\\zed group:8:{ variable:9:Z group:10:} spacing:11: macro:12:\\zed'),
    ('j % a remark\n+ 6', '', '0< root0 root; 1<0 child0 variable j; 2<0 child1 comment % a remark; 3<0 child2 operator +; 4<0 child3 number 6', 'variable:0:j spacing:1: comment:2:% a remark operator:3:+ spacing:4: number:5:6'),
    ('( [ ) ]', 'W unmatched_delimiter 0 0 Possibly unmatched delimiter: (', '0< root0 root; 1<0 child0 delimiter (; 2<0 child1 delimiter [; 3<0 child2 delimiter ); 4<0 child3 delimiter ]', 'delimiter:0:( spacing:1: delimiter:2:[ spacing:3: delimiter:4:) spacing:5: delimiter:6:]'),
    ('^6', '', '0< root0 root; 1<0 child0 superscript; 2<1 base0 empty; 3<1 child0 number 6', 'superscript:0:^ number:1:6'),
    ('\\mystery \\mystery \\textodd', 'W unknown_command 0 0 Unknown command: \\mystery', '0< root0 root; 1<0 child0 command \\mystery; 2<0 child1 command \\mystery; 3<0 child2 command \\textodd', 'command:0:\\mystery spacing:8: command:9:\\mystery spacing:17: command:18:\\textodd'),
    ('\\hat{\\alpha} \\sin 3.5e2', '', '0< root0 root; 1<0 child0 command \\hat; 2<0 child1 group; 3<2 child0 symbol \\alpha; 4<0 child2 operator \\sin; 5<0 child3 number 3.5e2', 'command:0:\\hat group:4:{ symbol:5:\\alpha group:11:} spacing:12: operator:13:\\sin spacing:17: number:18:3.5e2'),
    ('', '', '0< root0 root', ''),
    ('\\begin z', '', '0< root0 root; 1<0 child0 variable z', 'environment:0:\\begin spacing:6: variable:7:z'),
)

#: LaTeX and the inside of its MathML, without line breaks.
CONVERSIONS = (
    ('\\frac{a}{b+6}', '<mfrac><mi>a</mi><mrow><mi>b</mi><mo>+</mo><mn>6</mn></mrow></mfrac>'),
    ('\\sqrt{u}', '<msqrt><mi>u</mi></msqrt>'),
    ('\\sqrt[3]{v6}', '<mroot><mrow><mi>v</mi><mn>6</mn></mrow><mn>3</mn></mroot>'),
    ('r_1^2', '<msubsup><mi>r</mi><mn>1</mn><mn>2</mn></msubsup>'),
    ('\\sum_{i=1}^n i', '<msubsup><mo largeop="true" movablelimits="true">∑</mo><mrow><mi>i</mi><mo>=</mo><mn>1</mn></mrow><mi>n</mi></msubsup><mi>i</mi>'),
    ('\\int_0^6 f', '<msubsup><mo largeop="true">∫</mo><mn>0</mn><mn>6</mn></msubsup><mi>f</mi>'),
    ('\\text{so } s', '<mtext>so </mtext><mi>s</mi>'),
    ('\\vec{w}', '<mover><mi>w</mi><mo accent="true">→</mo></mover>'),
    ('\\mathbf{A} x', '<mstyle mathvariant="bold"><mi>A</mi></mstyle><mi>x</mi>'),
    ('\\left( \\frac{1}{6} \\right)', '<mo fence="true" stretchy="true">(</mo><mfrac><mn>1</mn><mn>6</mn></mfrac><mo fence="true" stretchy="true">)</mo>'),
    ('\\begin{pmatrix} 1 & 6 \\\\ 0 & 1 \\end{pmatrix}', '<mo fence="true" stretchy="true">(</mo><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>6</mn></mtd></mtr><mtr><mtd><mn>0</mn></mtd><mtd><mn>1</mn></mtd></mtr></mtable><mo fence="true" stretchy="true">)</mo>'),
    ('\\begin{cases} x & y \\\\ z \\end{cases}', '<mo fence="true" stretchy="true">{</mo><mtable columnalign="left left"><mtr><mtd><mi>x</mi></mtd><mtd><mtext> if </mtext><mi>y</mi></mtd></mtr><mtr><mtd><mi>z</mi></mtd></mtr></mtable>'),
    ('\\begin{align} g &= 6 \\\\ &= h \\end{align}', '<mtable columnalign="right left"><mtr><mtd columnalign="right"><mi>g</mi></mtd><mtd columnalign="left"><mo>=</mo><mn>6</mn></mtd></mtr><mtr><mtd columnalign="right"/><mtd columnalign="left"><mo>=</mo><mi>h</mi></mtd></mtr></mtable>'),
    ('\\binom{n}{6}', '<mo>(</mo><mfrac linethickness="0"><mi>n</mi><mn>6</mn></mfrac><mo>)</mo>'),
    ('\\alpha \\leq \\infty', '<mi>α</mi><mo>≤</mo><mo>∞</mo>'),
    ('5.25 < y', '<mn>5.25</mn><mo>&lt;</mo><mi>y</mi>'),
    ('f(x) = x!', '<mi>f</mi><mo>(</mo><mi>x</mi><mo>)</mo><mo>=</mo><mi>x</mi><mi>!</mi>'),
    ('\\overline{z}', '<mover><mi>z</mi><mo accent="true">¯</mo></mover>'),
    ('a \\quad b', '<mi>a</mi><mspace width="0.5em"/><mi>b</mi>'),
    ('\\unknowncmd q', '<mi>\\unknowncmd</mi><mi>q</mi>'),
    ('', ''),
    ('e^{-t}', '<msup><mi>e</mi><mrow><mo>−</mo><mi>t</mi></mrow></msup>'),
)

#: Text and its formulas as meant: span, type and LaTeX.
DETECTIONS = (
    ('Both $$u$$ and $v6$.', '5-10 display u; 15-19 inline v6'),
    ('Pay \\$5 and \\$6, then $w$.', '22-25 inline w'),
    ('\\[ a 6 \\] \\( b \\)', '0-9 display a 6; 10-17 inline b'),
    ('\\begin{align} $c$ \\end{align}', '0-29 align $c$'),
    ('Let $M = \\begin{pmatrix} 1 & 6 \\end{pmatrix} + q$ for all $c$ here', '4-49 inline M = \\begin{pmatrix} 1 & 6 \\end{pmatrix} + q; 58-61 inline c'),
    ('open $ only', ''),
    ('$a\nb$', ''),
    ('\\begin{equation*} d \\end{equation*}', '0-35 equation d'),
    ('\\begin{bmatrix} 7 \\end{bmatrix}', '0-31 matrix 7'),
    ('no formula', ''),
    ('$$e$ f$$ g$', '0-8 display e$ f'),
)

#: MathML and what is wrong with it.
VALIDATIONS = (
    ('<math xmlns="http://www.w3.org/1998/Math/MathML"><mi>x</mi></math>', ''),
    ('<math><mi>x</mi></math>', 'Missing or incorrect MathML namespace'),
    ('<math xmlns="http://www.w3.org/1998/Math/MathML"><mfrac><mi>x</mi></mfrac></math>', 'Element <mfrac> requires 2 children, found 1'),
    ('<math xmlns="http://www.w3.org/1998/Math/MathML"><div>x</div></math>', 'Invalid MathML element: <div>'),
    ('<math xmlns="http://www.w3.org/1998/Math/MathML"><mi><mn>1</mn></mi></math>', 'Element <mi> should not have child elements'),
    ('<mrow xmlns="http://www.w3.org/1998/Math/MathML"/>', 'Root element must be <math>'),
    ('<math xmlns="http://www.w3.org/1998/Math/MathML"><msubsup><mi>a</mi><mn>6</mn></msubsup></math>', 'Element <msubsup> requires 3 children, found 2'),
)

#: MathML and its shorter form, without line breaks.
OPTIMISATIONS = (
    ('<math><mrow><mi>x</mi></mrow></math>', '<math><mi>x</mi></math>'),
    ('<math><mrow/><mi>y</mi></math>', '<math><mi>y</mi></math>'),
    ('<math><mfrac><mrow/><mn>6</mn></mfrac></math>', '<math><mfrac><mrow/><mn>6</mn></mfrac></math>'),
    ('<math><mstyle><mi>z</mi><mo>+</mo></mstyle></math>', '<math><mi>z</mi><mo>+</mo></math>'),
    ('<math><mstyle mathvariant="bold"><mi>q</mi></mstyle></math>', '<math><mstyle mathvariant="bold"><mi>q</mi></mstyle></math>'),
    ('<math><mrow><mrow><mrow><mn>7</mn></mrow></mrow></mrow></math>', '<math><mn>7</mn></math>'),
    ('<math>', '<math>'),
)

#: A compiler's output and the telling part of it.
LOGS = (
    ('ok\n! Undefined control sequence.\nl.5 \\foo\n\nmore', '! Undefined control sequence. l.5 \\foo'),
    ('a\nb\n\nc\nd', 'b c d'),
    ('', 'Unknown error'),
    ('! One\n! Two\nx\ny', '! One ! Two x'),
    ('  \n \n', 'Unknown error'),
)

#: Name and bytes of a file, its text, and type and message of its error, %s for its full name.
FILES = (
    ("a.txt", b"$x$\r\n\xc3\xa9", "$x$\né", None, None),
    ("b.TEX", b"\\[ y \\]", "\\[ y \\]", None, None),
    ("c.pdf", b"%PDF", None, "unsupported_format", "PDF processing not yet implemented"),
    ("d.docx", b"PK", None, "unsupported_format", "Unsupported file format: .docx"),
    ("e.txt", b"\xff\xfe", None, "decode_error", "The file is not UTF-8"),
    ("f.tex", b"", "", None, None),
    ("gone.txt", None, None, "file_not_found", "File not found: %s"),
)
#: Pages as dark boxes (x, y, width, height) on 240 x 160 white pixels, and the regions of what may be formulas.
PAGES = (
    ((), ""),
    (((30, 40, 60, 20),), "25,35,70,30"),
    (((30, 40, 60, 20), (120, 10, 40, 12), (200, 100, 5, 5)), "115,5,50,22 25,35,70,30"),
    (((0, 0, 230, 30),), ""),
    (((2, 130, 100, 28),), "0,125,110,35"),
)
#: What a recognition service replies, and the result: LaTeX, confidence, error, backend.  The backends are "first", which fails, and "second".
REPLIES = (
    ({"latex": "x^2", "confidence": 0.9}, "x^2", 0.9, None, "second"),
    ({"text": "alpha >= 1/2", "confidence": 0.5}, "\\alpha \\geq 1/2", 0.5, None, "second"),
    ({"text": " p / q ", "confidence": 0.25}, "\\frac{p}{q}", 0.25, None, "second"),
    ({"latex": "", "confidence": 0.0}, "", 0.0, None, "second"),
    ({"latex": "", "confidence": 0.0, "error": "blurred"}, "", 0.0, "blurred", "second"),
)
