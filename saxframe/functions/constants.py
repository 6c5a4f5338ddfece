"""Fixed values of the event model: error codes with their texts, encodings, features, version."""

from __future__ import annotations

# The texts of the error codes, in order from 0.
ERRORS = [
    "no error",
    "out of memory",
    "syntax error",
    "no elements",
    "invalid token",
    "unclosed token",
    "partial character",
    "tag mismatch",
    "duplicate attribute",
    "junk after doc element",
    "param entity ref",
    "undefined entity",
    "recursive entity ref",
    "async entity",
    "bad char ref",
    "binary entity ref",
    "attribute external entity ref",
    "misplaced xml pi",
    "unknown encoding",
    "incorrect encoding",
    "unclosed cdata section",
    "external entity handling",
    "not standalone",
    "unexpected state",
    "entity declared in pe",
    "feature requires xml dtd",
    "can't change feature once parsing",
    "unbound prefix",
    "undeclaring prefix",
    "incomplete pe",
    "xml decl",
    "text decl",
    "publicid",
    "suspended",
    "not suspended",
    "aborted",
    "finished",
    "suspend pe",
    "reserved prefix xml",
    "reserved prefix xmlns",
    "reserved namespace uri",
    "invalid argument",
    "no buffer",
    "amplification limit breach",
    "not started",
]
(
    SYNTAX, NO_ELEMENTS, INVALID_TOKEN, UNCLOSED_TOKEN, PARTIAL_CHAR, TAG_MISMATCH, DUPLICATE_ATTRIBUTE, JUNK_AFTER_ROOT,
    PARAM_ENTITY_REF, UNDEFINED_ENTITY, RECURSIVE_ENTITY, ASYNC_ENTITY, BAD_CHAR_REF, BINARY_ENTITY_REF, ATTRIBUTE_EXTERNAL_REF,
    MISPLACED_XML_PI, UNKNOWN_ENCODING, INCORRECT_ENCODING, UNCLOSED_CDATA, EXTERNAL_ENTITY_HANDLING, NOT_STANDALONE,
) = range(2, 23)
UNEXPECTED_STATE, CANT_CHANGE_FEATURE = 23, 26
UNBOUND_PREFIX, UNDECLARING_PREFIX, INCOMPLETE_PE, XML_DECL, TEXT_DECL, PUBLIC_ID = range(27, 33)
SUSPENDED, NOT_SUSPENDED, ABORTED, FINISHED, SUSPEND_PE, RESERVED_XML, RESERVED_XMLNS, RESERVED_URI, INVALID_ARGUMENT, NO_BUFFER, AMPLIFICATION, NOT_STARTED = range(33, 45)

# The event types, in the order of the handler slots.
EVENT_TYPES = [
    "start_element", "end_element", "character_data", "processing_instruction", "comment", "start_cdata", "end_cdata",
    "default", "default_expand", "start_doctype", "end_doctype", "element_decl", "attlist_decl", "xml_decl", "entity_decl",
    "unparsed_entity_decl", "notation_decl", "start_namespace", "end_namespace", "not_standalone", "external_entity_ref",
    "skipped_entity", "unknown_encoding",
]

# Content model types and quantifiers.
CONTENT_TYPES = {"EMPTY": 1, "ANY": 2, "MIXED": 3, "NAME": 4, "CHOICE": 5, "SEQ": 6}
QUANTIFIERS = {"": 0, "?": 1, "*": 2, "+": 3}

VERSION = (2, 7, 5)
# The amplification limits: factor, bytes from which it holds, and bytes counted where none came in.
MAX_AMPLIFICATION, ACTIVATION_BYTES, SMALLEST_INPUT = 100.0, 8 * 1024 * 1024, 22

PREDEFINED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
XML_URI = "http://www.w3.org/XML/1998/namespace"
XMLNS_URI = "http://www.w3.org/2000/xmlns/"
