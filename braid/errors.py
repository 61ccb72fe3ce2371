"""What a graph refuses, one class for each reason."""

from __future__ import annotations


class GraphError(Exception):
    """Base of all; the fields of a refusal are its attributes."""

    def __init__(self, **fields: object):
        self.__dict__.update(fields)
        self.fields = fields
        super().__init__(f"{(self.__doc__ or '').strip()} {', '.join(f'{k}={v!r}' for k, v in fields.items())}".strip())

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.fields == other.fields

    __hash__ = Exception.__hash__


class VertexNotFound(GraphError):
    """No vertex has this id:"""


class HyperedgeNotFound(GraphError):
    """No hyperedge has this id:"""


class VertexWeightTaken(GraphError):
    """Another vertex has this weight:"""


class HyperedgeWeightTaken(GraphError):
    """Another hyperedge has this weight:"""


class VertexWeightUnchanged(GraphError):
    """The vertex already has this weight:"""


class HyperedgeWeightUnchanged(GraphError):
    """The hyperedge already has this weight:"""


class HyperedgeVerticesUnchanged(GraphError):
    """The hyperedge already has these vertices:"""


class NoVerticesToCreate(GraphError):
    """A new hyperedge needs a vertex:"""


class NoVerticesToUpdate(GraphError):
    """A hyperedge needs a vertex:"""


class TooFewToIntersect(GraphError):
    """An intersection needs two hyperedges:"""


class TooFewToJoin(GraphError):
    """A join needs two hyperedges:"""


class RepeatedInJoin(GraphError):
    """A hyperedge cannot be joined with itself:"""


class ContractionTargetMissing(GraphError):
    """The target is not among the vertices to contract:"""


class ContractionVerticesMissing(GraphError):
    """The hyperedge does not hold these vertices:"""


class InvalidWeight(GraphError):
    """Weights need exact equality, no nulls and a cost of 0 or more:"""
