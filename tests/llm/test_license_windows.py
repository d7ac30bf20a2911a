"""Licence notices that no line and no whole text holds by itself."""

import textwrap

import pytest

from ledgerloom.llm import licenses

PROSE = " ".join(f"The river of year {i} was wide, mill {i * 7} stood there." for i in range(60)) + " "
TEXT = {name: text for name, text in licenses.TEMPLATES}  # the longest of each comes last
MIT_FILE = "MIT License\n\nCopyright (c) 2020 A. Writer\n\n" + licenses.TEMPLATES[4][1] + '\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'


def wrapped(text):
    return "\n".join(textwrap.fill(p, 72) for p in text.split("\n"))


def test_notices_across_lines_and_within_lines(spark):
    cases = [
        (wrapped(MIT_FILE), "MIT", 1),
        *((PROSE + "\n" + wrapped(TEXT[name]) + "\n" + PROSE, name, 1) for name in ("MIT", "BSD-3-Clause", "GPL-3.0", "ISC")),
        (PROSE + "This work is licensed under the GNU General Public License, version 3. " + PROSE, "GPL-3.0", 1),
        ("It was a long day. Released under the MIT License. " + PROSE, "MIT", 1),
        ("Licensed under the Apache License, Version 2.0.\n" + PROSE + "Released under the MIT License.\n" + PROSE, "Apache-2.0", 2),
        ("Licensed under the Apache License, Version 2.0.\n" + PROSE, "Apache-2.0", 1),
        (PROSE + "It was released under the old and the new licence of MIT. " + PROSE, None, 0),
        (PROSE, None, 0),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert [(got[i]["license"], got[i]["n_matches"]) for i in range(len(cases))] == [(name, n) for _, name, n in cases]
    assert all(got[i]["score"] == pytest.approx(1.0) for i in range(9))
