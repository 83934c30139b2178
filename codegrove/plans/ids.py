"""Identifiers of metadata concepts."""

ROOT = 138875005
IS_A = 116680003
FSN = 900000000000003001
SYNONYM = 900000000000013009
DEFINITION = 900000000000550004
DESCRIPTION_TYPE = 900000000000446008
PREFERRED = 900000000000548007
ACCEPTABLE = 900000000000549004
DEFINED = 900000000000073002
PRIMITIVE = 900000000000074008
CONCEPT_ATTRIBUTE = 410662002
CONCRETE_ATTRIBUTE = 762706009
UNAPPROVED_ATTRIBUTE = 106237007
CORE_MODULE = 900000000000207008
MODEL_MODULE = 900000000000012004
LANGUAGE_REFSETS = 900000000000506000
EN_US = 900000000000509007
EN_GB = 900000000000508004
ASSOCIATIONS = 900000000000522004
POSSIBLY_EQUIVALENT = 900000000000523009
MOVED_TO = 900000000000524003
MOVED_FROM = 900000000000525002
REPLACED_BY = 900000000000526001
SAME_AS = 900000000000527005
WAS_A = 900000000000528000
PARTIALLY_EQUIVALENT = 1186924009
MODULE_DEPENDENCY = 900000000000534007
