"""A small drug vocabulary: two vocabularies, three levels, hub and self rows."""

import datetime

from termeval.sources.vocabulary import Vocabulary

CONCEPTS = [
    (1, "Acetaminophen", "RxNorm", "161", "S"),
    (2, "acetaminophen", "SNOMED", "387517004", "S"),
    (3, "Acetaminophen Oral Tablet", "RxNorm", "369097", "S"),
    (4, "Acetaminophen and Codeine Pill", "RxNorm", "817579", "S"),
    (5, "Codeine", "RxNorm", "2670", "S"),
    (6, "Analgesics", "ATC", "N02", "C"),
    (7, "Opioids; systemic", "ATC", "N02A", "C"),
    (8, "Nervous System", "ATC", "N", "C"),
    (9, "Omeprazole", "RxNorm", "7646", "S"),
    (10, "Retired product", "RxNorm", "0", None),
    (11, "Tylenol", "RxNorm", "202433", None),
    (12, "Acetaminophen Tablet", "SNOMED", "322236009", "S"),
]
SYNONYMS = [
    (1, "Paracetamol"),
    (1, "APAP tablet substance"),
    (5, "Methylmorphine"),
    (9, "Tablet for acid"),
    (9, "Tablet for acid"),
    (11, "Paracetamol brand"),
]
RELATIONS = [
    (1, 11, "Has tradename"),
    (1, 4, "Ingredient of"),
    (1, 4, "Part of"),
    (2, 10, "Maps to"),
    (5, 4, "Ingredient of"),
]
ANCESTORS = [
    (8, 6, 1, 1),
    (6, 1, 1, 1),
    (8, 1, 2, 3),
    (6, 5, 1, 2),
    (7, 5, 1, 1),
    (8, 5, 2, 2),
    (1, 3, 1, 1),
    (6, 3, 2, 2),
    (8, 3, 3, 4),
    (1, 1, 0, 0),
    (2, 2, 0, 0),
    (5, 5, 0, 0),
]
VECTORS = [
    (1, [1.0, 0.0, 0.0]),
    (3, [0.9, 0.1, 0.0]),
    (5, [0.0, 1.0, 0.0]),
    (9, [0.0, 0.0, 2.0]),
    (4, [2.0, 0.0, 0.0]),
    (99, [1.0, 0.0, 0.0]),
]


def toy_vocabulary(spark):
    day = datetime.date(2020, 1, 1)
    tables = {
        "concept": (CONCEPTS, "concept_id bigint, concept_name string, vocabulary_id string, concept_code string, standard_concept string"),
        "concept_synonym": ([(i, n, 4180186) for i, n in SYNONYMS], "concept_id bigint, concept_synonym_name string, language_concept_id bigint"),
        "concept_relationship": (
            [(a, b, kind, day, day, None) for a, b, kind in RELATIONS],
            "concept_id_1 bigint, concept_id_2 bigint, relationship_id string, valid_start_date date, valid_end_date date, invalid_reason string",
        ),
        "concept_ancestor": (ANCESTORS, "ancestor_concept_id bigint, descendant_concept_id bigint, min_levels_of_separation int, max_levels_of_separation int"),
        "concept_embedding": (VECTORS, "concept_id bigint, embedding array<float>"),
    }
    return Vocabulary.of({k: spark.createDataFrame(d, s) for k, (d, s) in tables.items()})
