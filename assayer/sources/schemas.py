"""Declared entry schemas: source columns, canonical names and canonical types."""

from __future__ import annotations

from dataclasses import dataclass

# Source column -> (canonical name, canonical type), required ones marked with *.
_PRODUCTION = {
    "Reference*": ("WO", "string"), "Worker*": ("Worker", "string"), "Item Number*": ("Item", "string"), "Qty Doing*": ("Qty", "double"),
    "Total Actual Hours*": ("Hours", "double"), "RAF Month*": ("RafMonth", "timestamp_ntz"), "RoundNo": ("RoundNo", "bigint"),
    "Process": ("Process", "string"), "Item Number (Size Adjusted)": ("SizeAdjustedGroup", "string"), "Customer Name": ("Customer", "string"),
    "Product Type": ("ProductType", "string"), "Material": ("Material", "string"), "Name": ("WorkerName", "string"), "Department": ("Department", "string"),
}
_HOURS = {
    "ProductionOrderNumber*": ("WO", "string"), "Worker*": ("Worker", "string"), "Name": ("WorkerName", "string"), "Department": ("Department", "string"),
    "RoundNo": ("RoundNo", "bigint"), "Final": ("Final", "double"), "Origin": ("Origin", "double"), "Idle": ("Idle", "double"), "WorkOrderStatus": ("Attempt", "string"),
}
_ORDERS = {
    "ProductionOrderNumber*": ("WO", "string"), "Status": ("Status", "string"), "MaxRAFDate": ("MaxRafDate", "timestamp_ntz"), "ItemNumber": ("Item", "string"),
    "GoodCW": ("GoodPieces", "double"), "StandardRuntime": ("StandardRuntime", "double"), "EarnedHours": ("EarnedHours", "double"),
}
_SKILL = {
    "Worker ID*": ("Worker", "string"), "Process*": ("Process", "string"), "Planner Verified Skill Level*": ("Skill", "double"),
    "EffectiveFrom": ("EffectiveFrom", "timestamp_ntz"), "Approver": ("Approver", "string"), "Version": ("Version", "string"), "Name": ("WorkerName", "string"),
}
_MAPPING = {
    "Item Number*": ("Item", "string"), "Item Number (Size Adjusted)": ("SizeAdjustedGroup", "string"), "Process*": ("Process", "string"),
    "Material": ("Material", "string"), "Product Type": ("ProductType", "string"),
}
_TICKET = {
    "QualityOrderId*": ("TicketId", "string"), "WO*": ("WO", "string"), "Item Number*": ("Item", "string"), "RoundNo*": ("RoundNo", "double"),
    "QCStatus*": ("Status", "string"), "QCQty*": ("Qty", "double"), "ExpectedQty*": ("ExpectedQty", "double"), "QC_Start*": ("QcStart", "timestamp_ntz"),
    "QC_Stop": ("QcStop", "timestamp_ntz"), "InitialWorker": ("InitialWorker", "string"), "JDescription": ("Description", "string"),
    "ValidatedDateTime": ("ValidatedDateTime", "timestamp_ntz"), "RoundPassQty": ("RoundPassQty", "double"), "RoundReworkFailQty": ("RoundReworkQty", "double"),
    "RoundScrapQty": ("RoundScrapQty", "double"), "RoundActualQty": ("RoundActualQty", "double"), "IsRoundValid": ("IsRoundValid", "double"),
}
_TOUCH = {
    "EventID*": ("EventId", "string"), "WO*": ("WO", "string"), "Worker*": ("Worker", "string"), "Process*": ("Process", "string"),
    "Worker_Start*": ("WorkerStart", "timestamp_ntz"), "Worker_Stop*": ("WorkerStop", "timestamp_ntz"),
}
_FACTOR = {
    "Item Number*": ("Item", "string"), "Process*": ("Process", "string"), "Factor*": ("Factor", "string"), "Score": ("Score", "double"), "Method": ("Method", "string"),
    "ConfidencePct": ("ConfidencePct", "double"), "ConfidenceStatus": ("ConfidenceStatus", "string"), "Evidence": ("Evidence", "string"), "Scorer": ("Scorer", "string"),
    "Approver": ("Approver", "string"), "Version": ("Version", "string"), "Approved": ("Approved", "string"), "DataQualityStatus": ("DataQualityStatus", "string"),
}
_BOM = {
    "FG BOM number*": ("Fg", "string"), "BOM number*": ("Node", "string"), "BOM item number*": ("NodeItem", "string"), "Component item number*": ("Component", "string"),
    "Supply BOM number*": ("Supply", "string"), "BOM quantity*": ("Qty", "double"), "BOM unit*": ("Unit", "string"), "Quantity*": ("Quantity", "double"),
    "Unit*": ("QuantityUnit", "string"), "Exclude weight*": ("Weight", "double"), "BOM CW size*": ("CwSize", "double"), "Item group*": ("ItemGroup", "string"),
    "Sequence*": ("Sequence", "double"), "Product name": ("ProductName", "string"), "Product name2": ("ProductName2", "string"),
}
_QUOTE = {"BOM number*": ("SemiBom", "string"), "BOM item number*": ("QuoteItem", "string"), "Minutes*": ("Minutes", "string")}
_REFERENCE = {
    "Reference*": ("WO", "string"), "Customer Name": ("Customer", "string"), "Product Type": ("ProductType", "string"), "RAF Month": ("RafMonth", "timestamp_ntz"),
}
_PILOT = {
    "WO*": ("WO", "string"), "Process*": ("Process", "string"), "Arm*": ("Arm", "string"), "AssignedWorker*": ("AssignedWorker", "string"),
    "RecommendationVersion": ("RecommendationVersion", "string"), "FollowedTop3": ("FollowedTop3", "boolean"), "OverrideReason": ("OverrideReason", "string"),
    "AssignmentTime": ("AssignmentTime", "timestamp_ntz"),
}

# Other spellings of source columns, per dataset.
ALIASES = {
    "production": [
        ("Quantity Doing", "Qty Doing"), ("Actual Hours", "Total Actual Hours"), ("Item number", "Item Number"), ("ItemNumber", "Item Number"),
        ("ItemId", "Item Number"), ("ProductionOrderNumber", "Reference"), ("WO", "Reference"), ("MaxRAFDate", "RAF Month"), ("Worker Name", "Name"),
    ],
    "qc_ticket": [
        ("ItemId", "Item Number"), ("ExpectedInspectionQty", "ExpectedQty"), ("StartCW", "ExpectedQty"), ("CreatedDateTime", "QC_Start"),
        ("QCWorkerWrkCtrId", "InitialWorker"),
    ],
}


@dataclass(frozen=True)
class Dataset:
    """A named dataset: its input folder and column map."""

    name: str
    folder: str
    columns: dict[str, tuple[str, str]]

    @property
    def required(self) -> list[str]:
        return [c[:-1] for c in self.columns if c.endswith("*")]

    @property
    def fields(self) -> dict[str, tuple[str, str]]:
        return {c.rstrip("*"): target for c, target in self.columns.items()}


DATASETS = {
    d.name: d
    for d in (
        Dataset("production", "01_Production", _PRODUCTION),
        Dataset("planner_skill", "02_Planner_Skills", _SKILL),
        Dataset("item_mapping", "03_Item_Mapping", _MAPPING),
        Dataset("qc_ticket", "04_QC_Tickets", _TICKET),
        Dataset("touch_event", "05_Touch_Events", _TOUCH),
        Dataset("engineering_factor", "06_Engineering_Factors", _FACTOR),
        Dataset("pilot_log", "07_Pilot_Log", _PILOT),
        Dataset("reference_master", "08_Reference_Master", _REFERENCE),
        Dataset("item_master", "09_Item_Master", _MAPPING),
        Dataset("worker_master", "10_Worker_Master", {"Worker*": ("Worker", "string"), "Name": ("WorkerName", "string")}),
        Dataset("mes_worker_hours", "11_Worker_Hours", _HOURS),
        Dataset("mes_work_orders", "12_Work_Orders", _ORDERS),
        Dataset("bom_line", "13_Bom", _BOM),
        Dataset("quote", "14_Quotes", _QUOTE),
    )
}
