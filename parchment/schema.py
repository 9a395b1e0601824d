"""Fixed schemas of the engine's tables."""

ELEMENTS = (
    "doc_id string, seq int, text string, confidence double, bbox array<array<double>>, center struct<x:int,y:int>, "
    "normalized_center struct<x:double,y:double>, image_dimensions struct<width:int,height:int>"
)
RECEIPTS = "doc_id string, success boolean, date string, total double, category string, error string"
PAIRS = "split string, stem string, ground_truth string, engine string, text string, error string"
