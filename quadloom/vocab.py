"""Vocabulary IRIs of RDF, RDFS, OWL and XSD (fixed values)."""

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"

TYPE, FIRST, REST, NIL, LANG_STRING = (RDF + x for x in ("type", "first", "rest", "nil", "langString"))
SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE = (RDFS + x for x in ("subClassOf", "subPropertyOf", "domain", "range"))
NOTHING, SAME_AS, DIFFERENT_FROM = (OWL + x for x in ("Nothing", "sameAs", "differentFrom"))
EQUIVALENT_CLASS, EQUIVALENT_PROPERTY = OWL + "equivalentClass", OWL + "equivalentProperty"
DISJOINT_WITH, PROPERTY_DISJOINT, INVERSE_OF, CHAIN = (OWL + x for x in ("disjointWith", "propertyDisjointWith", "inverseOf", "propertyChainAxiom"))
MEMBERS, DISTINCT_MEMBERS = OWL + "members", OWL + "distinctMembers"
ALL_DIFFERENT, ALL_DISJOINT_CLASSES, ALL_DISJOINT_PROPERTIES = (OWL + x for x in ("AllDifferent", "AllDisjointClasses", "AllDisjointProperties"))
FUNCTIONAL, INVERSE_FUNCTIONAL, TRANSITIVE, SYMMETRIC, ASYMMETRIC, REFLEXIVE, IRREFLEXIVE = (
    OWL + x + "Property" for x in ("Functional", "InverseFunctional", "Transitive", "Symmetric", "Asymmetric", "Reflexive", "Irreflexive")
)
#: Class-expression predicates that the bounded rules do not interpret.
UNSUPPORTED = tuple(
    OWL + x
    for x in (
        "allValuesFrom someValuesFrom onProperty hasValue unionOf intersectionOf complementOf oneOf "
        "minCardinality maxCardinality cardinality minQualifiedCardinality maxQualifiedCardinality qualifiedCardinality"
    ).split()
)
XSD_STRING, XSD_BOOLEAN, XSD_INTEGER, XSD_DECIMAL, XSD_FLOAT, XSD_DOUBLE, XSD_DATETIME, XSD_DATE, XSD_DURATION = (
    XSD + x for x in ("string", "boolean", "integer", "decimal", "float", "double", "dateTime", "date", "dayTimeDuration")
)
#: Datatypes derived from xsd:integer.
INTEGERS = tuple(
    XSD + x
    for x in (
        "integer nonPositiveInteger negativeInteger nonNegativeInteger positiveInteger long int short byte "
        "unsignedLong unsignedInt unsignedShort unsignedByte"
    ).split()
)
