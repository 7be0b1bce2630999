"""MathML and chemistry as TeX, and drawn formulas taken back."""

import pytest

from folioquarry.functions import mathml

CASES = [
    ("<mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mrow><mn>2</mn><mi>y</mi></mrow></mfrac>", "x=\\frac{1}{2y}"),
    ("<msup><mi>x</mi><mn>2</mn></msup><mo>+</mo><msub><mi>a</mi><mrow><mi>i</mi><mi>j</mi></mrow></msub>", "x^2+a_{ij}"),
    ("<msqrt><mi>x</mi><mo>−</mo><mn>1</mn></msqrt><mroot><mi>y</mi><mn>3</mn></mroot>", "\\sqrt{x-1}\\sqrt[3]{y}"),
    ("<munderover><mo>∑</mo><mrow><mi>i</mi><mo>=</mo><mn>1</mn></mrow><mi>n</mi></munderover><mi>i</mi>", "\\sum_{i=1}^ni"),
    ("<mover><mi>x</mi><mo>¯</mo></mover><mi>sin</mi><mi>θ</mi>", "\\bar{x}\\sin\\theta"),
    ("<mfenced open='[' close=')'><mi>a</mi><mi>b</mi></mfenced>", "\\left[a,b\\right)"),
    ("<mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mn>3</mn></mtd><mtd><mn>4</mn></mtd></mtr></mtable>", "\\begin{matrix}1 & 2 \\\\ 3 & 4\\end{matrix}"),
    ("<mtext>50% of</mtext><mi>NaCl</mi>", "\\text{50\\% of}\\mathrm{NaCl}"),
    ("<semantics><mi>α</mi><annotation>no</annotation></semantics><mi>b</mi>", "\\alpha b"),
]


@pytest.mark.parametrize(("inside", "want"), CASES)
def test_mathml(inside, want):
    assert mathml.tex_of(f'<math xmlns="http://www.w3.org/1998/Math/MathML">{inside}</math>') == want


def test_what_is_no_mathml():
    assert mathml.tex_of("<math><mi>x</math>") is None and mathml.tex_of("<p>x</p>") is None


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("H2O", "{\\mathrm{H}_{2}\\mathrm{O}}"), ("2H2 + O2 -> 2H2O", "{2\\,\\mathrm{H}_{2} + \\mathrm{O}_{2} \\rightarrow 2\\,\\mathrm{H}_{2}\\mathrm{O}}"), ("SO4^2-", "{\\mathrm{S}\\mathrm{O}_{4}^{2-}}"), ("Na+", "{\\mathrm{Na}^{+}}"),
        ("NaCl(aq) <=> Na+ + Cl-", "{\\mathrm{Na}\\mathrm{Cl}\\text{(aq)} \\rightleftharpoons \\mathrm{Na}^{+} + \\mathrm{Cl}^{-}}"), ("Ca(OH)2", "{\\mathrm{Ca}(\\mathrm{O}\\mathrm{H})_{2}}"), ("->", "\\rightarrow"), ("x?", None),
    ],
)
def test_chemistry(given, want):
    assert mathml.ce_tex(given) == want
    assert mathml.with_chemistry(f"a \\ce{{{given}}} b") == f"a {want or f'\\ce{{{given}}}'} b"


def test_drawn_formulas(spark):
    carried = '<p><mjx-container class="MathJax" jax="CHTML"><mjx-math><mjx-mi></mjx-mi></mjx-math><mjx-assistive-mml><math><mi>x</mi></math></mjx-assistive-mml></mjx-container></p>'
    scripted = '<span class="MathJax" id="a"><span>drawn</span></span><script type="math/tex; mode=display" id="b">x^2 </script>'
    lost = '<mjx-container jax="SVG"><svg></svg></mjx-container> kept <span class="plain">text</span>'
    rows = spark.createDataFrame([(0, carried), (1, scripted), (2, lost), (3, None)], "i int, html string")
    got = [r.x for r in rows.orderBy("i").select(mathml.drawings_rebuilt("html").alias("x")).collect()]
    assert got == ["<p><math><mi>x</mi></math></p>", '<span class="math display">x^2</span>', '<span class="math-lost"></span> kept <span class="plain">text</span>', None]
