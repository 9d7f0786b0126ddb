"""Column names, lists, labels, defaults and limits that results depend on."""

# Time-card columns every export must provide after mapping.
PUNCH_COLUMNS = [
    "ID",
    "Location",
    "Employee",
    "In Punch",
    "Out Punch",
    "Status",
    "Status Date",
]

# Payroll register columns: the first four are required, the rest optional.
REGISTER_CORE_COLUMNS = ["IDX", "Payroll Name", "Pay Date", "Location"]
REGISTER_COLUMNS = [
    "IDX",
    "Location",
    "Payroll Name",
    "Pay Date",
    "FLSA Status",
    "Position Status",
    "Hire Date",
    "Job Description",
    "Termination Date",
    "Regular Rate Paid",
    "Regular Hours",
    "Overtime Hours",
    "Double Time Hours",
    "Regular Earnings Total",
    "Overtime Earnings",
    "Misc FLSA Earnings",
    "Bonus Earnings",
    "Commission Earnings",
    "Auto Gratuity Earnings",
    "Restricted Service Charge Earnings",
    "Bellman Service Charge Earnings",
    "Double Time Earnings",
    "Break Credit Hours",
    "Break Credit Earnings",
    "Rest Credit Hours",
    "Rest Credit Earnings",
    "Sick Pay Hours",
    "Sick Pay Earnings",
    "Vacation Hours",
    "Vacation Earnings",
]
REGISTER_TEXT_COLUMNS = [
    "IDX",
    "Location",
    "Payroll Name",
    "FLSA Status",
    "Position Status",
    "Job Description",
]
REGISTER_DATE_COLUMNS = ["Pay Date", "Hire Date", "Termination Date"]

# Inputs of the regular rate of pay.
RATE_INPUTS = [
    "Regular Hours",
    "Overtime Hours",
    "Double Time Hours",
    "Regular Earnings Total",
    "Overtime Earnings",
    "Misc FLSA Earnings",
    "Bonus Earnings",
    "Commission Earnings",
    "Auto Gratuity Earnings",
    "Restricted Service Charge Earnings",
    "Bellman Service Charge Earnings",
]

# Columns each register check needs, in the order checks are reported.
CHECK_INPUTS = {
    "overtime_checks_variances": RATE_INPUTS,
    "doubletime_checks_variances": RATE_INPUTS + ["Double Time Earnings"],
    "break_credit_variances": RATE_INPUTS
    + ["Break Credit Hours", "Break Credit Earnings", "Regular Rate Paid"],
    "rest_credit_variances": RATE_INPUTS
    + ["Rest Credit Hours", "Rest Credit Earnings", "Regular Rate Paid"],
    "sick_credit_variances": RATE_INPUTS
    + ["FLSA Status", "Regular Rate Paid", "Sick Pay Hours", "Sick Pay Earnings"],
    "flsa_check": ["FLSA Status", "Regular Rate Paid", "Position Status"],
    "min_wage_check": [
        "Position Status",
        "FLSA Status",
        "Regular Hours",
        "Regular Earnings Total",
        "Regular Rate Paid",
        "Sick Pay Earnings",
        "Vacation Earnings",
    ],
    "non_active_check": [
        "Position Status",
        "Regular Hours",
        "Job Description",
        "Hire Date",
        "Vacation Hours",
        "Termination Date",
    ],
}

# Rule defaults. Rules without an entry here must be given by the client.
RULE_DEFAULTS = {
    "pay_period_length": 14,
    "days_bet_payroll_end_and_pay_date": 6,
    "min_wage": 17.25,
    "state_min_wage": 16.50,
    "pay_periods_per_year": 26,
    "time_gap_for_new_shift": 60.0,
}
REQUIRED_RULES = [
    "ot_day_max",
    "dt_day_max",
    "ot_week_max",
    "number_of_consec_days_before_ot",
    "workweek_start",
]
WEEKDAYS = {
    "monday": 0,
    "tuesday": 1,
    "wednesday": 2,
    "thursday": 3,
    "friday": 4,
    "saturday": 5,
    "sunday": 6,
}

# Thresholds written into the rules themselves.
EXEMPT_MIN_RATE = 100
PREMIUM_DAY_HOURS = 8
CENT = 0.01
REPORT_ROWS = 200
PUNCH_QUERY_ROWS = 300

# Punch columns that are stored, by group.
STORED_PUNCH_COLUMNS = [
    "ID",
    "Employee",
    "In Punch",
    "Out Punch",
    "Last Updated",
    "Pay Date",
    "Waiver on File?",
    "Location",
    "Status",
    "Status Date",
    "Punch Length (hrs)",
    "Break Time (min)",
    "Is Break?",
    "Is New Punch?",
    "Short Break",
    "Did Not Break",
    "12hr Credit Due",
    "Split Shift Due ($)",
    "RTP_Warning",
    "New Shift?",
    "Shift Number",
    "Hours Worked Shift",
    "Shift Start",
    "First Punch of Shift?",
    "Punch Number in Shift",
    "Over Twelve",
    "Break Count",
    "Break Order",
    "2nd Break Start",
    "Hours to 2nd Break",
]

# Report name of each internal punch column.
PUNCH_LABELS = {
    "id": "ID",
    "location": "Location",
    "employee": "Employee",
    "in_punch": "In Punch",
    "out_punch": "Out Punch",
    "status": "Status",
    "status_date": "Status Date",
    "work_date": "Date",
    "raw_hours": "Punch Length (hrs) Raw",
    "prev_in": "Prev In Punch",
    "prev_out": "Prev Out Punch",
    "next_in": "Next In Punch",
    "next_out": "Next Out Punch",
    "prev_date": "Prev Date",
    "next_date": "Next Date",
    "prev_hours": "Prev Punch Length (hrs)",
    "next_hours": "Next Punch Length (hrs)",
    "paid_break_hours": "Paid Break Credit (hrs)",
    "hire_date": "Hire Date",
    "has_waiver": "Waiver on File?",
    "break_min": "Break Time (min)",
    "new_shift": "New Shift?",
    "shift_no": "Shift Number",
    "shift_hours": "Hours Worked Shift",
    "shift_start": "Shift Start",
    "first_of_shift": "First Punch of Shift?",
    "is_break": "Is Break?",
    "break_count": "Break Count",
    "break_order": "Break Order",
    "second_break_start": "2nd Break Start",
    "hours_to_second_break": "Hours to 2nd Break",
    "twelve_hour_credit": "12hr Credit Due",
    "is_new_punch": "Is New Punch?",
    "punch_no": "Punch Number in Shift",
    "punch_hours": "Punch Length (hrs)",
    "rate_paid": "Regular Rate Paid",
    "split_paid": "Split Paid ($)",
    "split_at_min": "Split at Min Wage ($)",
    "split_due": "Split Shift Due ($)",
    "short_shift": "RTP_Warning",
    "short_break": "Short Break",
    "did_not_break": "Did Not Break",
    "first_meal_break": "First Meal Break",
    "over_twelve": "Over Twelve",
}

# Report name of each internal daily column, in stored order.
DAILY_LABELS = {
    "employee": "Employee",
    "id": "ID",
    "location": "Location",
    "workday": "Attributed_Workday",
    "hours_worked": "Hours_Worked",
    "regular_hours": "Regular_Hrs",
    "ot_hours": "OT_Hrs",
    "dt_hours": "DT_Hrs",
    "workweek": "Workweek_ID",
    "days_worked": "Days_Worked_In_Week",
    "consecutive_rule": "Is_Consecutive_Day_Rule",
    "cum_regular_hours": "Cum_Reg_Hrs",
    "weekly_spillover": "Weekly_OT_Spillover",
    "fiscal_pay_date": "Fiscal_Pay_Date",
    "ot_period": "OT_Hours_Pay_Period",
    "dt_period": "DT_Hours_Pay_Period",
    "ot_paid": "OT_Hours_Paid",
    "dt_paid": "DT_Hours_Paid",
    "ot_variance": "OT_Variance_(hrs)",
    "dt_variance": "DT_Variance_(hrs)",
    "first_day_of_streak": "First_Day_of_Streak",
    "consec_ot": "Consec_OT_Hours",
    "consec_dt": "Consec_DT_Hours",
}

ANOMALY_LABELS = {
    "id": "ID",
    "employee": "Employee",
    "paid_break_hours": "Paid Break Credit (hrs)",
    "due_break_hours": "Due Break Credit (hrs)",
    "variance": "Variance",
    "short_break": "Short Break",
    "did_not_break": "Did Not Break",
    "first_meal_break": "First Meal Break",
    "over_twelve": "Over Twelve",
}

# Reports: columns shown (before renaming) and the renames that take effect.
REGISTER_REPORTS = {
    "overtime_checks_variances": (
        ["IDX", "Payroll Name", "1.5 OT Earnings Due", "Actual Pay Check", "Variance"],
        {
            "Variance": "Variance ($)",
            "1.5 OT Earnings Due": "1.5 OT Earnings Due ($)",
            "Actual Pay Check": "Actual Pay Check ($)",
        },
    ),
    "doubletime_checks_variances": (
        ["IDX", "Payroll Name", "Double Time Due", "Actual Pay Check Dble", "Variance Dble"],
        {"Double Time Due": "Double Time Due ($)", "Variance Dble": "Variance Dble ($)"},
    ),
    "break_credit_variances": (
        [
            "IDX",
            "Payroll Name",
            "Break Credit Hours",
            "Break Credit Due",
            "Actual Pay BrkCrd",
            "Variance BrkCrd",
            "Break Credit Due / Break Credit Hours",
            "Regular Rate Paid",
        ],
        {
            "Actual Pay BrkCrd": "Actual Paid Break Credit",
            "Variance BrkCrd": "Variance Break Credit",
        },
    ),
    "rest_credit_variances": (
        [
            "IDX",
            "Payroll Name",
            "Rest Credit Hours",
            "Rest Credit Due",
            "Actual Pay RestCrd",
            "Variance RestCrd",
            "Rest Credit Due / Rest Credit Hours",
            "Regular Rate Paid",
        ],
        {
            "Actual Pay RestCrd": "Actual Paid Rest Credit ($)",
            "Variance RestCrd": "Variance Rest Credit ($)",
        },
    ),
    "sick_credit_variances": (
        [
            "IDX",
            "Payroll Name",
            "Sick Credit Hours",
            "Sick Credit Due",
            "Sick Paid",
            "Variance Sick",
            "Sick Credit Due / Sick Credit Hours",
            "Regular Rate Paid",
        ],
        {
            "Sick Credit Due": "Sick Credit Due ($)",
            "Sick Paid": "Actual Paid Sick Credit ($)",
            "Variance Sick": "Variance Sick Credit ($)",
            "Regular Rate Paid": "Regular Rate Paid ($)",
        },
    ),
    "flsa_check": (
        ["IDX", "Payroll Name", "Position Status", "FLSA Status", "Regular Rate Paid"],
        {},
    ),
    "min_wage_check": (
        [
            "IDX",
            "Payroll Name",
            "Position Status",
            "FLSA Status",
            "Regular Hours",
            "Base Rate",
            "Regular Rate Paid",
            "Sick Pay Earnings",
            "Vacation Earnings",
        ],
        {},
    ),
    "non_active_check": (
        [
            "IDX",
            "Payroll Name",
            "Position Status",
            "Job Description",
            "Hire Date",
            "Vacation Hours",
            "Termination Date",
            "Regular Hours",
        ],
        {"Regular Hours": "Straight Hours Worked"},
    ),
}
TIME_CARD_REPORTS = {
    "break_credit_summary": (
        [
            "ID",
            "Employee",
            "Paid Break Credit (hrs)",
            "Due Break Credit (hrs)",
            "Variance",
            "Short Break",
            "Did Not Break",
            "First Meal Break",
            "Over Twelve",
        ],
        {},
    ),
    "short_break_earned_credits": (
        [
            "Employee",
            "ID",
            "Prev In Punch",
            "Prev Out Punch",
            "Break Time (min)",
            "In Punch",
            "Punch Length (hrs)",
            "Paid Break Credit (hrs)",
            "Hours Worked Shift",
        ],
        {},
    ),
    "did_not_break_meal_waiver_check": (
        [
            "ID",
            "Employee",
            "Hire Date",
            "In Punch",
            "Out Punch",
            "Punch Length (hrs)",
            "Hours Worked Shift",
            "Paid Break Credit (hrs)",
            "Waiver on File?",
        ],
        {},
    ),
    "seven_consecutive": (
        [
            "Employee",
            "ID",
            "Attributed_Workday",
            "First_Day_of_Streak",
            "Consec_OT_Hours",
            "Consec_DT_Hours",
        ],
        {"Attributed_Workday": "Trigger Date"},
    ),
    "ot_vs_wfn": (
        ["Employee", "ID", "OT_Hours_Pay_Period", "OT_Hours_Paid", "OT_Variance_(hrs)"],
        {},
    ),
    "dt_vs_wfn": (
        ["Employee", "ID", "DT_Hours_Pay_Period", "DT_Hours_Paid", "DT_Variance_(hrs)"],
        {},
    ),
    "split_shift": (
        [
            "Employee",
            "ID",
            "Prev Out Punch",
            "In Punch",
            "Break Time (min)",
            "Regular Rate Paid",
            "Split Paid ($)",
            "Split at Min Wage ($)",
            "Split Shift Due ($)",
        ],
        {"Regular Rate Paid": "Straight Rate ($)"},
    ),
    "short_shift": (
        [
            "Employee",
            "ID",
            "Break Time (min)",
            "In Punch",
            "Out Punch",
            "Punch Length (hrs)",
            "Hours Worked Shift",
        ],
        {},
    ),
}

# Payroll export headers and the standard column each one feeds.
ADP_RENAMES = {
    "Location": "CO.",
    "Pay Date": "PAY DATE",
    "FLSA Status": "FLSA Code",
    "Hire Date": "HIREDATE",
    "Job Description": "Job Title Description",
    "Regular Hours": "REG",
    "Overtime Hours": "OT",
    "Double Time Hours": "DBLTIME HRS",
    "Overtime Earnings": "Overtime Earnings Total",
    "Misc FLSA Earnings": "A_MISC ADJUST_flsa earnings",
    "Bonus Earnings": "B_Bonus_Additional Earnings",
    "Commission Earnings": "C_Ee Commission_Additional Earnings",
    "Auto Gratuity Earnings": "E_Auto Gratuities_Additional Earnings",
    "Restricted Service Charge Earnings": "X_RESTR SVC CHG_Additional Earnings",
    "Bellman Service Charge Earnings": "Y_BELLMANSVCCHG_Additional Earnings",
    "Double Time Earnings": "D_Double Time_Additional Earnings",
    "Break Credit Hours": "J_Break Credits_Additional Hours",
    "Break Credit Earnings": "J_Break Credits_Additional Earnings",
    "Rest Credit Hours": "RC - Rest Credit Hours",
    "Rest Credit Earnings": "RC_Rest Credit_Earnings",
    "Sick Pay Hours": "S_Sick Pay_Hours",
    "Sick Pay Earnings": "S_Sick Pay_Earnings",
    "Vacation Hours": "V_Vacation_Hours",
    "Vacation Earnings": "V_Vacation_Earnings",
}

# Error codes and messages shown to the user of an intake.
PUNCH_SYSTEM_UNRECOGNIZED = "TA_SYSTEM_UNRECOGNIZED"
REGISTER_SYSTEM_UNRECOGNIZED = "WFN_SYSTEM_UNRECOGNIZED"
