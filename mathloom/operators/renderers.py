"""Renderers for ``render``: each uses a program or library that may be absent, and says so."""

from __future__ import annotations

import io
import shutil
import subprocess
import tempfile
from pathlib import Path

from mathloom.operators.render import RenderConfig


def error_message(output: str) -> str:
    """The telling lines of a compiler's output; the expression of the same meaning is ``latex_error_message``."""
    lines = output.split("\n")
    told: list[str] = []
    for i, line in enumerate(lines):
        if line.startswith("!"):
            told += [line, *(x for x in lines[i + 1 : i + 3] if x.strip())]
    filled = [x for x in lines if x.strip()]
    return " ".join(told[:3]) or " ".join(filled[-3:]) or "Unknown error"


def svg_to_png(svg: str, config: RenderConfig) -> bytes:
    """An SVG as PNG by whichever of two libraries is there."""
    try:
        import cairosvg
    except ImportError:
        try:
            from reportlab.graphics import renderPM
            from svglib.svglib import svg2rlg
        except ImportError:
            raise RuntimeError("No SVG converter available") from None
        return renderPM.drawToString(svg2rlg(io.BytesIO(svg.encode())), fmt="PNG", dpi=config.dpi)
    return cairosvg.svg2png(bytestring=svg.encode(), dpi=config.dpi, output_width=config.max_width, output_height=config.max_height)


#: Programs that turn a page into PNG, in the order they are tried: name and arguments between input and output.
_PAGES = (
    ("pdftoppm", lambda dpi, source, target: ["-png", "-singlefile", "-r", str(dpi), source, target.removesuffix(".png")]),
    ("convert", lambda dpi, source, target: ["-density", str(dpi), source, target]),
    ("gs", lambda dpi, source, target: ["-q", "-dSAFER", "-dBATCH", "-dNOPAUSE", "-sDEVICE=png16m", f"-r{dpi}", f"-sOutputFile={target}", source]),
)


def pdf_to_png(pdf: bytes, config: RenderConfig) -> bytes:
    """The first page of a PDF as PNG by whichever program is there."""
    for program, arguments in _PAGES:
        if shutil.which(program):
            with tempfile.TemporaryDirectory() as folder:
                source, target = Path(folder, "page.pdf"), Path(folder, "page.png")
                source.write_bytes(pdf)
                subprocess.run([program, *arguments(config.dpi, str(source), str(target))], capture_output=True, timeout=config.timeout)
                if target.exists():
                    return target.read_bytes()
    raise RuntimeError("No PDF converter available")


def _with_image(result: dict, config: RenderConfig) -> dict:
    """A result with a PNG, where that is asked for and can be made; else as it is."""
    if config.output_format != "png":
        return result
    try:
        image = pdf_to_png(result["pdf"], config) if "pdf" in result else svg_to_png(result["svg"], config)
    except (RuntimeError, OSError, subprocess.SubprocessError):
        return result
    return result | {"image": image}


class Pdflatex:
    """A formula as PDF, compiled by pdflatex in a folder of its own, and as PNG where a program for that is there."""

    name = "pdflatex"
    #: Fixed packages and page of the document around a formula.
    template = "\\documentclass[%dpt,border=%dpt]{standalone}\n\\usepackage{amsmath,amssymb,xcolor}\n\\begin{document}\n\\color{%s}$\\displaystyle %s$\n\\end{document}\n"

    def is_available(self) -> bool:
        return shutil.which("pdflatex") is not None

    def render(self, latex: str, config: RenderConfig) -> dict:
        with tempfile.TemporaryDirectory() as folder:
            source = Path(folder, "formula.tex")
            source.write_text(self.template % (config.font_size, config.padding, config.text_color, latex), encoding="utf-8")
            command = ["pdflatex", "-interaction=nonstopmode", "-halt-on-error", "-no-shell-escape", source.name]
            try:
                done = subprocess.run(command, cwd=folder, capture_output=True, text=True, errors="replace", timeout=config.timeout)
            except subprocess.TimeoutExpired:
                return {"error": f"Compilation took more than {config.timeout} s"}
            result = source.with_suffix(".pdf")
            if done.returncode or not result.exists():
                return {"error": error_message(done.stdout)}
            return _with_image({"pdf": result.read_bytes()}, config)


class Matplotlib:
    """A formula as PNG or SVG by matplotlib's own typesetting, which knows part of LaTeX."""

    name = "matplotlib"

    def is_available(self) -> bool:
        try:
            import matplotlib  # noqa: F401
        except ImportError:
            return False
        return True

    def render(self, latex: str, config: RenderConfig) -> dict:
        from matplotlib.figure import Figure

        figure = Figure()
        figure.text(0, 0, f"${latex}$", fontsize=config.font_size, color=config.text_color)
        out = io.BytesIO()
        kind = "svg" if config.output_format == "svg" else "png"
        figure.savefig(out, format=kind, dpi=config.dpi, bbox_inches="tight", pad_inches=config.padding / 72, transparent=config.transparent_background)
        return {"svg": out.getvalue().decode()} if kind == "svg" else {"image": out.getvalue()}


class Sympy:
    """A formula as PNG by SymPy's preview, which uses an installed LaTeX."""

    name = "sympy"

    def is_available(self) -> bool:
        try:
            import sympy  # noqa: F401
        except ImportError:
            return False
        return shutil.which("latex") is not None and shutil.which("dvipng") is not None

    def render(self, latex: str, config: RenderConfig) -> dict:
        from sympy import preview

        out = io.BytesIO()
        preview(f"$\\displaystyle {latex}$", viewer="BytesIO", outputbuffer=out, output="png", dvioptions=["-D", str(config.dpi)])
        return {"image": out.getvalue()}


class NodeMathML:
    """MathML as SVG by a typesetting package of Node, and as PNG where a library for that is there."""

    name = "node"
    script = (
        "const m=require('mathjax-node');let s='';process.stdin.on('data',d=>s+=d).on('end',()=>"
        "m.typeset({math:s,format:'MathML',svg:true},r=>{if(r.errors)throw r.errors.join();process.stdout.write(r.svg)}))"
    )

    def is_available(self) -> bool:
        if shutil.which("node") is None:
            return False
        return subprocess.run(["node", "-e", "require('mathjax-node')"], capture_output=True, timeout=5).returncode == 0

    def render(self, mathml: str, config: RenderConfig) -> dict:
        done = subprocess.run(["node", "-e", self.script], input=mathml, capture_output=True, text=True, timeout=config.timeout)
        return {"error": done.stderr.strip() or "Unknown error"} if done.returncode else _with_image({"svg": done.stdout}, config)


class Molecule:
    """A structure given as SMILES, drawn as SVG."""

    name = "molecule"

    def is_available(self) -> bool:
        try:
            import rdkit  # noqa: F401
        except ImportError:
            return False
        return True

    def render(self, smiles: str, config: RenderConfig) -> dict:
        from rdkit import Chem
        from rdkit.Chem.Draw import rdMolDraw2D

        molecule = Chem.MolFromSmiles(smiles)
        if molecule is None:
            return {"error": "Invalid SMILES"}
        drawer = rdMolDraw2D.MolDraw2DSVG(config.max_width or 400, config.max_height or 400)
        drawer.DrawMolecule(molecule)
        drawer.FinishDrawing()
        return {"svg": drawer.GetDrawingText()}


#: Renderers of LaTeX in the order they are tried.
LATEX = (Pdflatex(), Sympy(), Matplotlib())
