"""Word lists. Results depend on each of them."""

#: Words that carry no signal in code search and in whole-word matching.
SEARCH_STOP = tuple("""
a an the is are was were be been being have has had do does did will would could should may might must shall can
cannot this that these those it its what which who whom whose when where why how and or but not nor so yet for in on
at to from of with by about into through during i me my we our you your he him his she her they them their there here
any all some no few more most other such only own same than too very just get got use used using make made like also
then out up over after before between each both if as until while because though although tell show give find know
see look say go put set let try help need want code file line add new old run work
""".split())

#: Words that carry no signal when a query is expanded.
EXPANSION_STOP = tuple("""
a an the is are was were be been being have has had do does did will would could should may might must shall can
cannot this that these those it its what which who whom whose when where why how and or but not so for in on at to
from of with by about i me my we our you your he him his she her they them their there here any all some no get make
use like just tell show give find know see say go put set let try help need want code file line add run work project
repo repository app application
""".split())

#: Words left out when summaries are matched.
SUMMARY_STOP = tuple("""
a an the is it in of on to for and or but not be are was were this that with from by at as do does did how what where
when which who why has have had can could would should will may might
""".split())

#: Words that are no evidence.
EVIDENCE_STOP = tuple("""
the a an and or but to for of in on at by with from is are was were be what which how does do did this that these
those value values config configuration model models repo repository project all any some used use using again back
tell show list get give also just still ever here
""".split())


def sql_list(words) -> str:
    """The words as the inside of an SQL IN list."""
    return ", ".join(f"'{w}'" for w in words)
