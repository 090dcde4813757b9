"""Vocabularies of the LaTeX grammar and the symbol table for MathML."""

from __future__ import annotations

# The word lists and tables that decide results, as the grammar defines them.

MATH_TYPES = tuple("inline display equation align matrix cases gather multiline unknown".split())

GREEK = frozenset(
    """alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi pi varpi rho
    varrho sigma varsigma tau upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi
    Omega ell hbar imath jmath aleph beth gimel daleth""".split()
)
FUNCTIONS = frozenset(
    """sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh coth log ln lg exp lim limsup liminf sup inf max
    min det dim ker rank span trace deg gcd lcm Pr arg mod bmod pmod hom ext tor im Re Im""".split()
)
ACCENTS = frozenset(
    """hat check breve acute grave tilde bar vec dot ddot dddot overline underline widehat widetilde overrightarrow
    overleftarrow overbrace underbrace overarc wideparen""".split()
)
FONTS = frozenset(
    """mathrm mathbf mathit mathsf mathtt mathcal mathscr mathbb mathfrak boldsymbol text textbf textit textrm textsf
    texttt emph textsc textsl textup textnormal""".split()
)
SPACING = frozenset(
    """, : ; ! quad qquad hspace vspace hfill vfill smallskip medskip bigskip thinspace medspace thickspace
    negthinspace negmedspace negthickspace phantom hphantom vphantom""".split()
)
STRUCTURAL = frozenset(
    """frac sqrt left right begin end limits nolimits text mbox hbox vbox not binom choose over atop above below
    stackrel overset underset newcommand def let renewcommand providecommand""".split()
)
#: Commands that no warning is given for, besides macros and names that begin with "text".
KNOWN_COMMANDS = GREEK | FUNCTIONS | FONTS | ACCENTS | SPACING | STRUCTURAL

INTEGRALS = (r"\int", r"\iint", r"\iiint", r"\oint")
SUMS_PRODUCTS = (r"\sum", r"\prod")
CLOSERS = {"(": ")", "[": "]"}
WIDE_ACCENTS = (r"\widehat", r"\widetilde", r"\overrightarrow", r"\overleftarrow")

#: Substrings whose presence raises the confidence of a formula.
MATH_MARKS = tuple(r"+ - = < > \ { } ^ _ frac sqrt sum int prod alpha beta".split())

#: Weights of a formula's complexity, in the order they are added.
COMPLEXITY = (
    ("tokens", 0.05),
    ("depth", 0.4),
    ("environments", 0.8),
    ("fractions", 0.6),
    ("integrals", 1.0),
    ("sums_products", 0.8),
    ("matrices", 1.2),
    ("scripts", 0.2),
    ("roots", 0.4),
    ("delimiters", 0.1),
    ("nested_scripts", 0.5),
    ("macros", 0.3),
    ("optionals", 0.15),
)

#: Replacements of recognised text, in order.
OCR_REPLACEMENTS = (
    ("sqrt", r"\sqrt"),
    ("sum", r"\sum"),
    ("int", r"\int"),
    ("alpha", r"\alpha"),
    ("beta", r"\beta"),
    ("gamma", r"\gamma"),
    ("pi", r"\pi"),
    ("+-", r"\pm"),
    (">=", r"\geq"),
    ("<=", r"\leq"),
    ("!=", r"\neq"),
    ("infinity", r"\infty"),
)


#: Symbols for MathML, by category.
SYMBOLS = {
    "operators": {
        "+": "+", "-": "−", "*": "⋅", "/": "/", "=": "=", "<": "<", ">": ">", r"\pm": "±", r"\mp": "∓", r"\times": "×", r"\div": "÷",
        r"\cdot": "⋅", r"\circ": "∘", r"\bullet": "•", r"\star": "⋆", r"\ast": "∗", r"\neq": "≠", r"\ne": "≠", r"\leq": "≤", r"\le": "≤",
        r"\geq": "≥", r"\ge": "≥", r"\ll": "≪", r"\gg": "≫", r"\subset": "⊂", r"\supset": "⊃", r"\subseteq": "⊆", r"\supseteq": "⊇",
        r"\in": "∈", r"\notin": "∉", r"\ni": "∋", r"\sim": "∼", r"\simeq": "≃", r"\approx": "≈", r"\cong": "≅", r"\equiv": "≡",
        r"\propto": "∝", r"\parallel": "∥", r"\perp": "⊥", r"\mid": "∣", r"\nmid": "∤", r"\vee": "∨", r"\wedge": "∧", r"\oplus": "⊕",
        r"\ominus": "⊖", r"\otimes": "⊗", r"\oslash": "⊘", r"\odot": "⊙", r"\cap": "∩", r"\cup": "∪", r"\sqcap": "⊓", r"\sqcup": "⊔",
        r"\vdash": "⊢", r"\dashv": "⊣", r"\models": "⊨", r"\therefore": "∴", r"\because": "∵", r"\emptyset": "∅", r"\infty": "∞",
        r"\partial": "∂", r"\nabla": "∇",
    },
    "greek_letters": {
        "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "varepsilon": "ϵ", "zeta": "ζ", "eta": "η", "theta": "θ",
        "vartheta": "ϑ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "varpi": "ϖ", "rho": "ρ",
        "varrho": "ϱ", "sigma": "σ", "varsigma": "ς", "tau": "τ", "upsilon": "υ", "phi": "φ", "varphi": "ϕ", "chi": "χ", "psi": "ψ",
        "omega": "ω", "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Upsilon": "Υ",
        "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
    },
    "functions": {
        "sin": "sin", "cos": "cos", "tan": "tan", "log": "log", "ln": "ln", "exp": "exp", "lim": "lim", "max": "max", "min": "min",
    },
    "delimiters": {
        "(": "(", ")": ")", "[": "[", "]": "]", r"\{": "{", r"\}": "}", r"\langle": "⟨", r"\rangle": "⟩", "|": "|", r"\|": "‖",
    },
    "accents": {
        "hat": "^", "tilde": "˜", "bar": "¯", "vec": "→", "dot": "˙", "ddot": "¨", "overline": "¯",
    },
}
LARGE_OPERATORS = {
    r"\sum": "∑", r"\prod": "∏", r"\int": "∫", r"\iint": "∬", r"\iiint": "∭", r"\oint": "∮",
}
MATH_VARIANTS = {
    "mathbf": "bold", "mathit": "italic", "mathrm": "normal", "mathsf": "sans-serif", "mathtt": "monospace", "mathcal": "script",
    "mathbb": "double-struck", "mathfrak": "fraktur",
}
FENCES = {"pmatrix": "()", "bmatrix": "[]", "Bmatrix": "{}", "vmatrix": "||", "Vmatrix": "‖‖"}

MATHML_TAGS = frozenset(
    """math mrow mi mn mo mtext mspace ms mglyph msub msup msubsup munder mover munderover mmultiscripts mtable mtr
    mtd mlabeledtr mstack mlongdiv msgroup msrow mscarries mscarry msline mfrac msqrt mroot mstyle merror mpadded
    mphantom mfenced menclose maction semantics annotation annotation-xml mprescripts none maligngroup
    malignmark""".split()
)
MATHML_TOKENS = frozenset("mi mn mo mtext ms".split())
MATHML_ARITY = {"mfrac": 2, "msub": 2, "msup": 2, "msubsup": 3, "munder": 2, "mover": 2, "munderover": 3, "mroot": 2}
MATHML_NAMESPACE = "http://www.w3.org/1998/Math/MathML"
#: Longest LaTeX that is converted.
MATHML_INPUT_LIMIT = 10_000
