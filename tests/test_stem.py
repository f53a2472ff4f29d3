"""Stems published with the algorithm, and ROUGE-L over stems."""

import pytest

from textloom.functions import drift
from textloom.functions.stem import stem

PUBLISHED = """caresses caress,ponies poni,ties tie,caress caress,cats cat,feed feed,agreed agre,plastered plaster,bled bled,motoring motor,sing sing,conflated conflat,troubled troubl,sized size,hopping hop,tanned tan,falling fall,
hissing hiss,fizzed fizz,failing fail,filing file,happy happi,relational relat,conditional condit,rational ration,valenci valenc,digitizer digit,conformabli conform,radicalli radic,differentli differ,vileli vile,
analogousli analog,vietnamization vietnam,predication predic,operator oper,feudalism feudal,decisiveness decis,hopefulness hope,callousness callous,formaliti formal,sensitiviti sensit,sensibiliti sensibl,triplicate triplic,
formative form,formalize formal,electriciti electr,electrical electr,hopeful hope,goodness good,revival reviv,allowance allow,inference infer,airliner airlin,gyroscopic gyroscop,adjustable adjust,defensible defens,
irritant irrit,replacement replac,adjustment adjust,dependent depend,adoption adopt,homologou homolog,communism commun,activate activ,angulariti angular,homologous homolog,effective effect,bowdlerize bowdler,probate probat,
rate rate,cease ceas,controll control,roll roll,skies sky,dying die,died die,news news,succeed succeed,is is"""


@pytest.mark.parametrize("pair", PUBLISHED.replace("\n", "").split(","))
def test_stems(pair):
    word, want = pair.split()
    assert stem(word) == want


def test_rouge_l_stems_longer_words():
    assert drift.rouge_l("the mills were turning", "the mill was turned") == pytest.approx(0.75)
    assert drift.rouge_l("saw", "saws") == 1.0 and drift.rouge_l("", "x") == 0.0
