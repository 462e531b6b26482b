"""Bootstrap assertions: the typing of the engine's own predicates, and text templates for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gnosia.model import edges_of

#: Bootstrap facts (fixed values), loaded without checks.
FACTS = """
(isa isa BinaryPredicate)
(isa isa DefaultMonotonicPredicate)
(argIsa isa '2 Collection)
(isa genls BinaryPredicate)
(isa genls DefaultMonotonicPredicate)
(argIsa genls '1 Collection)
(argIsa genls '2 Collection)
(genls BinaryPredicate Predicate)
(isa disjointWith SymmetricBinaryPredicate)
(isa disjointWith DefaultMonotonicPredicate)
(argIsa disjointWith '1 Collection)
(argIsa disjointWith '2 Collection)
(genls CollectionOrder Collection)
(isa Individual Collection)
(disjointWith Individual Collection)
(isa Collection Collection)
(isa Thing Collection)
(genls Collection Thing)
(isa Relation Collection)
(genls UnaryRelation Relation)
(isa UnaryRelation Collection)
(isa Predicate Collection)
(genls Predicate Relation)
(isa SpecialRelation Collection)
(genls SpecialRelation UnaryRelation)
(isa BinaryPredicate Collection)
(isa Function-Denotational Collection)
(isa TheFn Function-Denotational)
(resultIsaArg TheFn '1)
(genls Function-Denotational Relation)
(isa resultGenl BinaryPredicate)
(isa resultGenl DefaultMonotonicPredicate)
(argIsa resultGenl '1 Function-Denotational)
(argIsa resultGenl '2 Collection)
(isa resultIsa BinaryPredicate)
(isa resultIsa DefaultMonotonicPredicate)
(argIsa resultIsa '1 Function-Denotational)
(argIsa resultIsa '2 Collection)
(isa resultGenlArg Predicate)
(isa resultGenlArg DefaultMonotonicPredicate)
(argIsa resultGenlArg '1 Function-Denotational)
(argIsa resultGenlArg '2 PositiveInteger)
(isa resultIsaArg Predicate)
(isa resultIsaArg DefaultMonotonicPredicate)
(argIsa resultIsaArg '1 Function-Denotational)
(argIsa resultIsaArg '2 PositiveInteger)
(isa preservesGenlsInArg BinaryPredicate)
(argIsa preservesGenlsInArg '2 PositiveInteger)
(isa preservesIsaInArg BinaryPredicate)
(argIsa preservesIsaInArg '2 PositiveInteger)
(isa StrictlyFunctionalSlot Collection)
(isa comment StrictlyFunctionalSlot)
(isa arity StrictlyFunctionalSlot)
(isa nlpPredicateString StrictlyFunctionalSlot)
(genlPreds prettyString termStrings)
(genlPreds prettyString-Canonical prettyString)
(isa CharacterString Collection)
(isa (TheFn CharacterString) CharacterString)
(isa nlpPredicateString BinaryPredicate)
(arity nlpPredicateString '2)
(argIsa nlpPredicateString '1 Predicate)
(argIsa nlpPredicateString '2 CharacterString)
(isa URLFn UnreifiableFunction)
(isa Individual CollectionOrder)
(isa Individual FirstOrderCollection)
(genls FirstOrderCollection Collection)
(isa FirstOrderCollection CollectionOrder)
(genls SecondOrderCollection Collection)
(isa FirstOrderCollection SecondOrderCollection)
(isa SecondOrderCollection CollectionOrder)
(isa PositiveInteger Collection)
(isa NegativeInteger Collection)
(isa Zero Individual)
(isa PositiveNumber Collection)
(isa NegativeNumber Collection)
(isa True Individual)
(isa False Individual)
(isa Date Collection)
(isa DayFn UnreifiableFunction)
(resultIsa DayFn Date)
(isa MonthFn UnreifiableFunction)
(resultIsa MonthFn Date)
(isa YearFn UnreifiableFunction)
(resultIsa YearFn Date)
(isa laterThan BinaryPredicate)
(argIsa laterThan '1 Date)
(argIsa laterThan '2 Date)
(isa TimeInterval Collection)
(isa TimeIntervalInclusiveFn UnreifiableFunction)
(isa different EvaluatablePredicate)
(isa equals EvaluatablePredicate)
(isa greaterThan EvaluatablePredicate)
(isa greaterThanOrEqualTo EvaluatablePredicate)
(isa lessThan EvaluatablePredicate)
(isa lessThanOrEqualTo EvaluatablePredicate)
(isa laterThan EvaluatablePredicate)
(isa numericallyEquals EvaluatablePredicate)
(isa not SpecialRelation)
(isa removed SpecialRelation)
(isa RefinablePredicate Collection)
(genls RefinablePredicate BinaryPredicate)
"""
#: Text templates of predicates (fixed values): $n is an argument, /n(one)/(what things)/ chooses by argument n.
TEMPLATES = {
    "argGenl": "/2(argument $2)/(what arguments)/ of $1 is a type of $3",
    "arg1Genl": "argument 1 of $1 is a type of $2",
    "arg2Genl": "argument 2 of $1 is a type of $2",
    "argIsa": "/2(argument $2)/(what arguments)/ of $1 is an instance of $3",
    "arg1Isa": "argument 1 of $1 is an instance of $2",
    "arg2Isa": "argument 2 of $1 is an instance of $2",
    "argNotGenl": "/2(argument $2)/(what arguments)/ of $1 cannot be a type of $3",
    "arg1NotGenl": "argument 1 of $1 cannot be a type of $2",
    "arg2NotGenl": "argument 2 of $1 cannot be a type of $2",
    "argNotIsa": "/2(argument $2)/(what arguments)/ of $1 cannot be an instance of $3",
    "arg1NotIsa": "argument 1 of $1 cannot be an instance of $2",
    "arg2NotIsa": "argument 2 of $1 cannot be an instance of $2",
    "arity": "$1 /1(has)/(have)/ arity /2($2)/(what)/",
    "assertedSentence": "$1 /1(is)/(are)/ asserted directly",
    "broaderTerm": "$2 /2(is)/(are)/ broader than $1",
    "comment": "$1 /1(has)/(have)/ /2(comment $2)/(what comment)/",
    "different": "$1 /1(is)/(are)/ different to $2",
    "disjointWith": "$1 /1(is)/(are)/ disjoint with $2",
    "genlInverse": "$1 /1(is)/(are)/ a supertype of $2",
    "genlMt": "$1 /1(is)/(are)/ a sub-microtheory of $2",
    "genlPreds": "$1 /1(is)/(are)/ a sub-predicate of $2",
    "genls": "$1 /1(is)/(are)/ a kind of $2",
    "isa": "$1 /1(is)/(are)/ an instance of $2",
    "laterThan": "$1 /1(is)/(are)/ later than $2",
    "nlpPredicateString": "$2 /2(is)/(are)/ the NL predicate string for $1",
    "prettyString": "$1 /1(is)/(are)/ known as $2",
    "prettyString-Canonical": "$1 /1(is)/(are)/ commonly known as $2",
    "quotedIsa": "$1 /1(is)/(are)/ implicitly an instance of $2",
    "resultGenl": "$2 /2(is)/(are)/ the type produced by $1",
    "resultIsa": "$2 /2(is)/(are)/ the instance produced by $1",
    "resultGenlArg": "the type produced by $1 /1(is)/(are)/ the same as /2(argument $2)/(what arguments)/",
    "resultIsaArg": "the instance produced by $1 /1(is)/(are)/ the same as /2(argument $2)/(what arguments)/",
    "rewriteOf": "$1 /1(is)/(are)/ the favoured rewrite of $2",
    "siblingDisjointExceptions": "$1 /1(is)/(are)/ exempt from disjointness with $2",
    "termStrings": "$1 /1(is)/(are)/ also known as $2",
}


def assertions() -> list[str]:
    return [*filter(None, FACTS.splitlines()), *(f'(nlpPredicateString {p} "{t}")' for p, t in TEMPLATES.items())]


def seed(spark: SparkSession) -> DataFrame:
    """The bootstrap edge table; edge ids are below zero, so that they clash with none of a loaded file."""
    edges = edges_of(spark, assertions())
    return edges.withColumn("edge_id", -1 - edges["edge_id"])
