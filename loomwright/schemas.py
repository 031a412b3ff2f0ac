"""Row types of the tables that operators exchange."""

ENTITIES = "unit_id string, pos bigint, name string, type string, description string"
RELATIONS = "unit_id string, pos bigint, subject string, predicate string, object string"
NODES = "graph_id string, id string, name string, type string, description string, properties map<string,string>"
EDGES = "graph_id string, id string, src string, rel string, dst string, properties map<string,string>"
TRIPLES = "header string, relation string, tail string"

SNAPSHOT_NODE = (
    "struct<pos:bigint,id:string,name:string,label:string,type:string,category:string,description:string,properties:map<string,string>>"
)
SNAPSHOT_EDGE = (
    "struct<pos:bigint,id:string,source:string,sourceId:string,subject:string,target:string,targetId:string,object:string,"
    "relation:string,predicate:string,label:string,type:string,properties:map<string,string>>"
)
SNAPSHOT = f"struct<nodes:array<{SNAPSHOT_NODE}>,edges:array<{SNAPSHOT_EDGE}>,relations:array<{SNAPSHOT_EDGE}>>"

MODEL_OUTPUT = (
    "struct<entities:array<struct<name:string,type:string,description:string>>,"
    "relations:array<struct<subject:string,predicate:string,object:string>>>"
)
IMPORT_DOCUMENT = (
    "struct<entities:array<struct<name:string,type:string,properties:map<string,string>>>,"
    "relationships:array<struct<source:string,target:string,type:string,properties:map<string,string>>>>"
)
