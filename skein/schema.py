"""Column types of the tables that operators take and return, as DDL."""

NODE_KINDS = "module", "function", "block", "statement", "call", "assign", "variable", "parameter", "source", "sink", "gate"
EDGE_KINDS = "control", "data", "call", "taint", "trust", "auth"

NODES = "graph_id string, pos long, id string, kind string, label string, file string, line int, end_line int, attrs map<string,string>"
EDGES = "graph_id string, pos long, src string, dst string, kind string, weight double, cost double, relation string, attrs map<string,string>"
#: A graph as one JSON document.
GRAPH_JSON = (
    "meta map<string,string>, nodes array<struct<id:string,kind:string,label:string,file:string,line:int,end_line:int,attrs:map<string,string>>>, "
    "edges array<struct<src:string,dst:string,kind:string,attrs:map<string,string>>>"
)
FINDINGS = "graph_id string, file string, line int, category string, sink string, severity string, score double, source_names array<string>, path array<string>, auth_gates array<string>"
